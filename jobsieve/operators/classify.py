"""Keyword and role classification."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.headcount import with_size_tests
from jobsieve.functions.let import apart, apply, bind, once, text
from jobsieve.functions.text import strip_sql
from jobsieve.operators.dedupe import distinct_in_category
from jobsieve.operators.rules import (
    KeywordRule,
    RoleRule,
    any_term_sql,
    default_keyword_rules,
    default_role_rules,
)
from jobsieve.operators.spread import many_join, measured
from jobsieve.operators.substrings import substring_join
from jobsieve.session import ready_for_checkpoint


_NO_HITS = "array<struct<hit: struct<category_id: string, category_name: string, keyword_pos: int, keyword: string>, lead: boolean>>"


def keyword_hits(df: DataFrame, rules: Iterable[KeywordRule] | None = None) -> DataFrame:
    """One row per posting and keyword whose terms occur in the role, with _hit; its lead marks the first of a category.

    The rules become one array of tests per row and category, so there is no join at all.  Tests, the first hit of each
    category and the arrays are columns in steps, compiled apart from the rest of their stage.
    """
    rules = default_keyword_rules() if rules is None else list(rules)
    by_category: dict[str, list[KeywordRule]] = {}
    for r in sorted(rules, key=lambda r: r.keyword_pos):
        by_category.setdefault(r.category_id, []).append(r)
    if not by_category:
        return df.withColumn("_hit", F.explode(F.array().cast(_NO_HITS)))
    hit, first, arrays = {}, {}, {}
    for i, ranked in enumerate(by_category.values()):
        for k, r in enumerate(ranked):
            hit[f"_hit{i}_{k}"] = F.expr(f"coalesce({any_term_sql('_lower', r.terms)}, false)")
        first[f"_first{i}"] = F.expr(f"CASE {' '.join(f'WHEN _hit{i}_{k} THEN {k}' for k in range(len(ranked)))} END")
        tests = ", ".join(
            f"CASE WHEN _hit{i}_{k} THEN named_struct('hit', named_struct('category_id', {text(r.category_id)}, 'category_name', "
            f"{text(r.category_name)}, 'keyword_pos', {r.keyword_pos}, 'keyword', {text(r.keyword)}), 'lead', _first{i} = {k}) END"
            for k, r in enumerate(ranked)
        )
        arrays[f"_tests{i}"] = F.expr(f"array({tests})")
    tested = apart(df.withColumn("_lower", F.lower("job_role")), **hit).withColumns(first)
    hits = apart(tested, **arrays).select(*df.columns, F.explode(F.concat(*arrays)).alias("_hit"))
    return hits.filter("_hit IS NOT NULL")


def keyword_match(df: DataFrame, rules: Iterable[KeywordRule] | DataFrame | None = None) -> DataFrame:
    """`keyword_match`: one row per posting and keyword whose terms occur in the role.

    Rules may also be a table of any size, (category_id, category_name, keyword_pos, keyword, term): then the
    distinct roles meet the terms in a substring join, and the postings meet the hits of their role.  Blank terms
    of a table match nothing.
    """
    if not isinstance(rules, DataFrame):
        return keyword_hits(df, rules).select(*df.columns, "_hit.hit.*")
    keyword = ["category_id", "category_name", "keyword_pos", "keyword"]
    termed = rules.select(*keyword, F.lower(F.trim("term")).alias("pattern"))
    # null roles match nothing below; a filter here would move below the joins and clean the role once more
    roles = df.select(F.lower("job_role").alias("text")).distinct()
    found = substring_join(roles, termed.select("pattern").distinct())
    hits, small = measured(found.join(termed, "pattern").select("text", *keyword).distinct())
    met = many_join(df.withColumn("text", F.lower("job_role")), hits, "text", small)
    return met.select(*df.columns, *keyword)


def classify_role(c: Column, rules: Iterable[RoleRule] | None = None) -> Column:
    """`classify_role`: first category with a matching term, else Other."""
    rules = default_role_rules() if rules is None else list(rules)
    cases = " ".join(
        f"WHEN r RLIKE {text('|'.join(re.escape(t) for t in rule.terms))} THEN {text(rule.category)}"
        for rule in rules
    )
    label = f"CASE {cases} ELSE {text(fixed.OTHER_ROLE)} END" if cases else text(fixed.OTHER_ROLE)
    return apply(bind(f"lower({strip_sql('x')})", "r", label), c)


def with_role_category(df: DataFrame, rules: Iterable[RoleRule] | None = None) -> DataFrame:
    return df.withColumn("role_category", classify_role(F.col("job_role"), rules))


def eligible_sizes(df: DataFrame) -> DataFrame:
    """The rows that pass the store gate, with _small: fewer than 100 people.

    The gate reads a headcount that is parsed once.  A plain filter would take a copy of the parser along for each
    time that its rule names the headcount, down to the scan.
    """
    tested = with_size_tests(df, "_small", "_unspecified")
    sized = once(tested, **{c: F.col(c) for c in ("number_of_people", "_small", "_unspecified")})
    return sized.filter("_small OR _unspecified").drop("_unspecified")


def eligible(df: DataFrame) -> DataFrame:
    """`size_eligible` as a filter: the store gate."""
    return eligible_sizes(df).drop("_small")


def category_jobs(
    df: DataFrame, rules: Iterable[KeywordRule] | None = None, order: str = "ingest_pos"
) -> DataFrame:
    """`category_jobs`: eligible postings per category and keyword, by size bucket.

    Rows with a null keyword are the category level, distinct by company and role.  Both levels read the same hits,
    which are checkpointed, so that postings are cleaned, parsed and tested once.
    """
    sized = eligible_sizes(df).withColumn("_size", F.when(F.col("_small"), "under_100").otherwise("unspecified"))
    ready_for_checkpoint(df.sparkSession)
    hits = keyword_hits(sized.drop("_small"), rules).checkpoint()
    names = [*df.columns, "_size", "_hit.hit.*"]
    matches = hits.select(*names)
    # equal roles hit the same keywords, so a pair's first match is the lead of its category
    per_category = distinct_in_category(hits.filter("_hit.lead").select(*names), order).withColumns(
        {"keyword": F.lit(None).cast("string"), "keyword_pos": F.lit(-1)}
    )
    both = matches.unionByName(per_category)
    return both.withColumn("bucket", F.explode(F.array(F.lit("all"), F.col("_size")))).drop("_size")
