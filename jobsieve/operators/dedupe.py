"""Deduplication by normalised URL or by company and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve.functions.text import clean_company, clean_role, normalize_key
from jobsieve.functions.urls import normalize_url
from jobsieve.operators.spread import first_by


def dedupe_key(company: Column, role: Column, url: Column) -> Column:
    """Normalised URL when there is one, else 'company_key::role_key'."""
    by_url = F.nullif(normalize_url(url), F.lit(""))
    by_names = F.concat(normalize_key(company), F.lit("::"), normalize_key(role))
    return F.coalesce(by_url, by_names)


def with_clean_names(df: DataFrame) -> DataFrame:
    """Replace company and role by their cleaned forms."""
    return df.withColumns(
        {
            "company_name": clean_company(F.col("company_name")),
            "job_role": clean_role(F.col("job_role")),
        }
    )


def with_dedupe_key(df: DataFrame) -> DataFrame:
    key = dedupe_key(F.col("company_name"), F.col("job_role"), F.col("job_url"))
    return df.withColumn("dedupe_key", key)


def dedupe_postings(df: DataFrame) -> DataFrame:
    """`dedupe_postings`: the first arrival per key survives."""
    return first_by(with_dedupe_key(df), ["dedupe_key"]).drop("dedupe_key")


def duplicates_count(df: DataFrame) -> DataFrame:
    """`duplicates_count`: number of rows that deduplication removes."""
    keyed = with_dedupe_key(df).select("dedupe_key")
    return keyed.agg(
        (F.count(F.lit(1)) - F.count_distinct("dedupe_key")).alias("duplicates_removed")
    )


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Keep every row and add is_duplicate.

    The winners are joined back on (key, ingest_pos); the position is unique, so
    a key with many copies does not load one task.
    """
    keyed = with_dedupe_key(df)
    winners = keyed.groupBy("dedupe_key").agg(F.min("ingest_pos").alias("ingest_pos"))
    winners = winners.withColumn("_first", F.lit(True))
    joined = keyed.join(winners, ["dedupe_key", "ingest_pos"], "left")
    flag = F.col("_first").isNull().alias("is_duplicate")
    return joined.select(*df.columns, "dedupe_key", flag)


def distinct_in_category(matches: DataFrame, order: str = "ingest_pos") -> DataFrame:
    """`distinct_in_category`: first match per category, lower company and lower role."""
    keyed = matches.withColumns(
        {
            "_company": F.lower("company_name"),
            "_role": F.lower("job_role"),
            "_rank": F.struct("keyword_pos", order),
        }
    )
    best = keyed.groupBy("category_id", "_company", "_role").agg(F.min_by(F.struct(*matches.columns), "_rank").alias("_row"))
    return best.select("_row.*")
