"""Row filters of the read views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.let import once
from jobsieve.functions.predicates import valid_headcount_sql, valid_names_sql
from jobsieve.functions.text import clean_text


def _has(c: Column | str, term: str) -> Column:
    return F.contains(F.lower(c), F.lit(term))


def like_any(c: Column | str, text: str) -> Column:
    """Contains with the wildcards of LIKE (% and _), ignoring case."""
    column = F.col(c) if isinstance(c, str) else c
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def with_validity(df: DataFrame) -> DataFrame:
    """Add is_valid: the `valid_record` test.

    The cleaned names are columns of their own that filters stay above, so Spark compiles the rules and cleans once.
    """
    names = ("company_name", "job_role")
    cleaned = once(df, **{f"_clean_{c}": clean_text(F.col(c)) for c in names})
    ok = f"({valid_headcount_sql('number_of_people')} AND {valid_names_sql(*names, *[f'_clean_{c}' for c in names])})"
    return cleaned.withColumn("is_valid", F.expr(ok)).select(*[c for c in df.columns if c != "is_valid"], "is_valid")


def valid_record(df: DataFrame) -> DataFrame:
    """`valid_record`: valid company, role and headcount; company and role differ."""
    # cleaned names and parsed sizes are kept, or the filter would clean and parse them once more
    tested = ("company_name", "job_role", "number_of_people")
    return with_validity(once(df, **{c: F.col(c) for c in tested})).filter("is_valid").drop("is_valid")


def engineering_filter(df: DataFrame) -> DataFrame:
    """`engineering_filter`: by parent category, else by terms in title and categories."""
    empty = F.array().cast("array<string>")
    parents = F.transform(F.coalesce("parent_categories", empty), F.lower)
    by_parent = F.arrays_overlap(parents, F.lit(list(fixed.ENGINEERING_PARENTS)))
    words = F.concat_ws(" ", F.coalesce("job_role", F.lit("")), F.coalesce("categories", empty))
    searchable = F.translate(F.lower(words), "-", " ")
    staged = df.withColumns({"_parent": by_parent, "_words": searchable})
    by_term = reduce(
        lambda a, b: a | b, [F.contains("_words", F.lit(t)) for t in fixed.ENGINEERING_TERMS]
    )
    return staged.filter(F.col("_parent") | by_term).select(*df.columns)


def source_filter(df: DataFrame, source: str | None) -> DataFrame:
    """`source_filter`: one of the two feeds by name; anything else keeps all rows."""
    name = (source or "all").lower()
    if name in (fixed.FEED_A_SOURCE, fixed.FEED_B_SOURCE):
        return df.filter(_has("source_website", name))
    return df


def search_preview(
    df: DataFrame, status: str = "ALL", size: str = "ALL", term: str = ""
) -> DataFrame:
    """`search_preview`: by status, exact size, and a term in company or role."""
    label = F.when(F.col("is_new"), F.lit("NEW")).otherwise(F.lit("EXISTING"))
    keep = F.lit(True)
    if status != "ALL":
        keep = keep & (label == status)
    if size != "ALL":
        keep = keep & (F.col("number_of_people") == size)
    if term.strip():
        wanted = term.lower()
        keep = keep & (_has("company_name", wanted) | _has("job_role", wanted))
    return df.filter(keep)


def search_stream(df: DataFrame, term: str) -> DataFrame:
    """`search_stream`: a term in company, role or headcount."""
    if not term.strip():
        return df
    wanted = term.lower()
    columns = ("company_name", "job_role", "number_of_people")
    return df.filter(reduce(lambda a, b: a | b, [_has(c, wanted) for c in columns]))


def search_feed(df: DataFrame, category: str = "All", term: str = "") -> DataFrame:
    """`search_feed`: by role category and a term in role or company."""
    keep = F.lit(True)
    if category != "All":
        keep = keep & (F.col("role_category") == category)
    wanted = term.strip().lower()
    if wanted:
        keep = keep & (_has("job_role", wanted) | _has("company_name", wanted))
    return df.filter(keep)


def new_only(df: DataFrame, fallback: bool = True) -> DataFrame:
    """`new_only`: only new rows; with fallback, all rows when none is new.

    The fallback asks a scalar subquery for "is any row new", so the rows
    themselves are only filtered.
    """
    if not fallback:
        return df.filter("is_new")
    any_new = df.agg(F.coalesce(F.bool_or("is_new"), F.lit(False))).scalar()
    return df.filter(F.col("is_new") | ~any_new)
