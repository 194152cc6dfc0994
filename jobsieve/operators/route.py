"""Routing of postings to export tabs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.dates import date_tab, moment
from jobsieve.functions.headcount import size_bucket
from jobsieve.functions.text import safe_category_title, safe_tab_title, strip
from jobsieve.operators.classify import category_jobs, classify_role
from jobsieve.operators.rules import KeywordRule, RoleRule, default_keyword_rules
from jobsieve.operators.topk import application_rownum


def status_label() -> Column:
    return F.when(F.col("is_new"), F.lit("NEW")).otherwise(F.lit("EXISTING"))


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def posting_row(df: DataFrame) -> DataFrame:
    """`posting_row`: the seven export columns with defaults and NEW/EXISTING."""
    na = fixed.NOT_AVAILABLE
    return df.select(
        "company_name",
        "job_role",
        _or("location", na).alias("location"),
        "number_of_people",
        _or("posted_by", na).alias("posted_by"),
        "posted_date",
        status_label().alias("status"),
    )


def route_master_tabs(df: DataFrame) -> DataFrame:
    """`route_master_tabs`: one row per posting and tab; a posting lands in several tabs."""
    status = F.when(F.col("is_new"), F.lit("New Jobs Only")).otherwise(
        F.lit("Existing Jobs Only")
    )
    tabs = F.concat(
        F.array(F.lit("All Jobs"), status),
        F.coalesce(size_bucket(F.col("number_of_people")), F.array().cast("array<string>")),
    )
    return df.withColumn("tab", F.explode(tabs))


def route_category_tabs(
    df: DataFrame,
    rules: Iterable[KeywordRule] | None,
    category: str,
    order: str = "ingest_pos",
) -> DataFrame:
    """`route_category_tabs`: the category tab, its under-100 tab, and two per keyword."""
    rules = default_keyword_rules() if rules is None else list(rules)
    chosen = [r for r in rules if r.category_id == category]
    rows = category_jobs(df, chosen, order).filter(F.col("bucket") != "unspecified")
    whole = F.col("keyword").isNull()
    small = F.col("bucket") == "under_100"
    title = (
        F.when(whole & small, F.lit("< 100 People (All)"))
        .when(whole, F.concat(F.lit("All "), "category_name", F.lit(" Jobs")))
        .when(small, F.concat("keyword", F.lit(" (<100)")))
        .otherwise(F.col("keyword"))
    )
    return rows.withColumn("tab", safe_tab_title(title)).drop("bucket")


def route_application_tabs(apps: DataFrame, tie: Sequence[str] = ("contact",)) -> DataFrame:
    """`route_application_tabs`: numbered applications with defaults, one tab per category."""
    numbered = application_rownum(apps, tie)
    optional = ("linkedin_url", "company_name", "job_url", "current_salary", "expected_salary",
                "notice_period")
    filled = numbered.withColumns(
        {
            **{name: _or(name, "") for name in optional},
            "resume_filename": _or("resume_filename", "No resume"),
            "tab": safe_category_title(F.col("role_category")),
        }
    )
    return filled.select(
        "tab", "row_number", "name", "contact", "linkedin_url", "job_role", "company_name",
        "job_url", "current_salary", "expected_salary", "notice_period", "resume_filename",
        "applied_at",
    )


def route_date_tabs(df: DataFrame) -> DataFrame:
    """`route_date_tabs`: one tab per first-seen date."""
    return df.withColumn("date_tab", date_tab(F.col("first_seen_at")))


def write_tabs(df: DataFrame, path: str, tab: str = "tab", mode: str = "overwrite") -> None:
    """Write routed rows, one folder per tab.

    Rows stay in their tasks, so a tab that holds most rows is written by many
    tasks; mode 'append' leaves what is there untouched.
    """
    df.write.mode(mode).option("maxRecordsPerFile", 1_000_000).partitionBy(tab).parquet(path)


def application_rows(
    df: DataFrame, applied_at, rules: Iterable[RoleRule] | None = None
) -> DataFrame:
    """Trim the submitted fields, classify the role and stamp the time."""
    required = ("name", "contact", "job_role")
    optional = ("linkedin_url", "company_name", "job_url", "current_salary", "expected_salary",
                "notice_period")
    trimmed = {name: strip(F.col(name)) for name in required}
    trimmed |= {
        name: F.when(F.col(name) != "", strip(F.col(name))) for name in optional
    }
    return df.withColumns(
        {
            **trimmed,
            "role_category": classify_role(F.col("job_role"), rules),
            "applied_at": moment(applied_at),
        }
    )


def write_application(
    df: DataFrame, path: str, applied_at, rules: Iterable[RoleRule] | None = None
) -> None:
    """`write_application`: append submitted applications to the table."""
    application_rows(df, applied_at, rules).write.mode("append").parquet(path)


def export_name(df: DataFrame, source: str | None = None) -> DataFrame:
    """`export_name`: name of the master export with its row count."""
    feed_b = bool(source) and fixed.FEED_B_SOURCE in source.lower()
    prefix = f"{fixed.FEED_B_SOURCE.capitalize()}_Jobs" if feed_b else "All_Scraped_Jobs"
    return df.agg(
        F.concat(F.lit(f"{prefix}_Master_"), F.count(F.lit(1)).cast("string")).alias("name")
    )


def category_export_name(category: Column, source: str | None = None) -> Column:
    """`export_name`, category variant: the file of a category with the source in front."""
    files = F.create_map(*[F.lit(x) for pair in fixed.CATEGORY_FILES.items() for x in pair])
    named = source and source.lower() != "all"
    return F.concat(F.lit(f"{source.capitalize()}_" if named else ""), files[category])
