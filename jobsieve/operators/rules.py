"""Keyword rules and role categories as arguments of the classifiers."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from jobsieve import fixed
from jobsieve.functions.let import text


class KeywordRule(NamedTuple):
    """One keyword of one category with the terms that select it."""

    category_id: str
    category_name: str
    keyword_pos: int
    keyword: str
    terms: tuple[str, ...]


class RoleRule(NamedTuple):
    """One role category; rules are tried in order."""

    category: str
    terms: tuple[str, ...]


def default_keyword_rules() -> list[KeywordRule]:
    return [
        KeywordRule(category_id, name, pos, keyword, terms)
        for category_id, name, keywords in fixed.CATEGORY_KEYWORDS
        for pos, (keyword, terms) in enumerate(keywords)
    ]


def default_role_rules() -> list[RoleRule]:
    return [RoleRule(category, terms) for category, terms in fixed.ROLE_CATEGORIES]


def rules_frame(spark: SparkSession, rules: Iterable[KeywordRule]) -> DataFrame:
    """The rules without their terms, one row per keyword."""
    return spark.createDataFrame(
        [(r.category_id, r.category_name, r.keyword_pos, r.keyword) for r in rules],
        "category_id string, category_name string, keyword_pos int, keyword string",
    )


def terms_frame(spark: SparkSession, rules: Iterable[KeywordRule]) -> DataFrame:
    """The rules as a table, one row per term."""
    return spark.createDataFrame(
        [(*r[:4], term) for r in rules for term in r.terms],
        "category_id string, category_name string, keyword_pos int, keyword string, term string",
    )


def any_term_sql(lower: str, terms: Iterable[str]) -> str:
    """SQL test: the lower-case text contains one of the trimmed terms.

    A term inside which another one stands needs no test of its own.
    """
    every = {t.strip().lower() for t in terms}
    trimmed = sorted(t for t in every if not any(o != t and o in t for o in every))
    return "(" + " OR ".join(f"contains({lower}, {text(t)})" for t in trimmed) + ")"
