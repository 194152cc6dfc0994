"""Bind a value once inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once per row.

    Catalyst expressions are trees: naming an argument five times in Python
    copies its tree five times, and nested copies multiply until the generated
    code no longer compiles.  A one-element array transform is the built-in way
    to give the value a name.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with some columns set to values that are evaluated once per row, also when filters follow.

    A filter moves below the column that it reads and takes a copy of its expression along; below rows that a
    generator made it does not move.  The values are columns first, because Spark compiles them there and would
    interpret rules as arguments of the generator.
    """
    others = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*columns)))
    names = [*df.columns, *[n for n in columns if n not in df.columns]]
    return df.withColumns(columns).select(*others, made).select(*names)


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that Spark compiles by themselves, in short methods.

    Spark makes one method of a whole stage.  Many rules make it longer than what Java's compiler takes, and it is
    interpreted, some ten times slower.  A projection with an array function is left out of that method, so the first
    column gets one.
    """
    first, *_ = columns
    return df.withColumns({**columns, first: let(columns[first], lambda value: value)})


def bind(value: str, name: str, body: str) -> str:
    """The same in SQL text: ``body`` with ``name`` standing for ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def apply(body: str, value: Column, name: str = "x") -> Column:
    """SQL text ``body`` over a column, called ``name`` in the text.

    The rules of a long function reach the driver's JVM as one text instead of
    hundreds of single calls, which keeps building a plan cheap.
    """
    rule = F.expr(f"{name} -> {body}")
    return F.get(F.call_function("transform", F.array(value), rule), F.lit(0))


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values) -> str:
    """A list of SQL string literals."""
    return ", ".join(text(v) for v in values)
