"""Joins with the company dimension, detail pages and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.dates import age_label_fine, from_source, normalize_published
from jobsieve.functions.headcount import headcount_sql, profile_size_from_html
from jobsieve.functions.let import once
from jobsieve.functions.text import normalize_key, strip_name
from jobsieve.functions.urls import company_slug, in_scope, normalize_url, slug_from_url
from jobsieve.operators.spread import first_by, lookup_join
from jobsieve.operators.substrings import substring_join


def scan_profiles(profiles: DataFrame) -> DataFrame:
    """`scan_profiles`: slug -> headcount, without empty counts."""
    return profiles.filter(F.col("employee_count") != "").select("company_slug", "employee_count")


def lookup_profile(profiles: DataFrame, slug: str) -> DataFrame:
    """`lookup_profile`: the headcount of one slug, lower-cased and trimmed."""
    wanted = slug.lower().strip()
    return scan_profiles(profiles).filter(F.col("company_slug") == wanted)


def enrich_headcount(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """`enrich_headcount`: fill a missing headcount by URL slug, then by name slug."""
    known = scan_profiles(profiles)
    missing = F.coalesce(
        F.trim("number_of_people").isin(*fixed.SIZE_TO_ENRICH), F.lit(True)
    )
    # rows that need nothing get null keys and match nothing
    keyed = df.withColumns(
        {
            "_url_slug": F.when(missing, slug_from_url(F.col("job_url"))),
            "_name_slug": F.when(missing, company_slug(F.col("company_name"))),
        }
    )
    for key, value in (("_url_slug", "_by_url"), ("_name_slug", "_by_name")):
        side = known.select(
            F.col("company_slug").alias(key), F.col("employee_count").alias(value)
        )
        keyed = lookup_join(keyed, side, [key])
    found = F.coalesce(
        "_by_url",
        "_by_name",
        F.nullif("number_of_people", F.lit("")),
        F.lit(fixed.NOT_AVAILABLE),
    )
    return keyed.withColumn("number_of_people", found).select(*df.columns)


def attach_company_size(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """`attach_company_size`: feed posting -> headcount of its company slug, else N/A."""
    side = scan_profiles(profiles).withColumnRenamed("employee_count", "_size")
    joined = lookup_join(df.drop("number_of_people"), side, ["company_slug"])
    size = F.coalesce("_size", F.lit(fixed.NOT_AVAILABLE))
    return joined.withColumn("number_of_people", size).drop("_size")


def missing_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """`missing_profiles`: slugs of the batch without a stored profile."""
    slugs = df.filter(F.col("company_slug") != "").select("company_slug").distinct()
    return slugs.join(scan_profiles(profiles), "company_slug", "left_anti")


def page_lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """One page per wanted URL: (page_key, html), the lowest page_id wins; other pages are not moved."""
    keyed = pages.select(normalize_url(F.col("url")).alias("page_key"), "page_id", "html")
    keyed = keyed.join(wanted.select("page_key").distinct(), "page_key", "left_semi")
    return first_by(keyed, ["page_key"], "page_id").select("page_key", "html")


def company_size_once(df: DataFrame, pages: DataFrame, base: Column | None = None) -> DataFrame:
    """`company_size_once`: resolve each company at most once.

    The first posting of a company without a headcount of its own decides: its
    profile page text, else N/A.  All later ones reuse that answer.
    """
    # what the filter reads is kept, or the filter would clean and parse it once more
    keyed = once(df, _company=normalize_key(F.col("company_name")), number_of_people=F.col("number_of_people"))
    unsized = F.col("number_of_people") == fixed.NOT_AVAILABLE
    site = F.col("page_url") if base is None else base
    url = F.when(in_scope(F.col("company_url"), site), normalize_url(F.col("company_url")))
    first = (
        keyed.filter(unsized & (F.col("_company") != ""))
        .withColumn("page_key", url)
        .groupBy("_company")
        .agg(F.min_by(F.struct("page_key"), "ingest_pos").alias("_f"))
        .select("_company", "_f.page_key")
    )
    sizes = first.join(page_lookup(pages, first.filter("page_key IS NOT NULL")), "page_key", "left").select(
        "_company",
        F.coalesce(profile_size_from_html(F.col("html")), F.lit(fixed.NOT_AVAILABLE)).alias(
            "_size"
        ),
    )
    joined = lookup_join(keyed, sizes, ["_company"])
    people = F.when(unsized, F.coalesce("_size", "number_of_people")).otherwise(
        F.col("number_of_people")
    )
    return joined.withColumn("number_of_people", people).select(*df.columns)


def unsized_companies(store: DataFrame, source: str, n: int = fixed.BACKFILL_COMPANIES) -> DataFrame:
    """`unsized_companies`: companies of a source without headcount, most postings first."""
    people = F.col("number_of_people")
    rows = store.filter(
        (F.col("source_website") == source)
        & (people.isNull() | (people == fixed.NOT_AVAILABLE))
    )
    top = (
        rows.groupBy("company_name")
        .agg(F.count(F.lit(1)).alias("postings"), F.min("job_url").alias("job_url"))
        .orderBy(F.desc("postings"), "company_name")
        .limit(n)
    )
    slug = F.coalesce(slug_from_url(F.col("job_url")), company_slug(F.col("company_name")))
    return top.select("company_name", "postings", slug.alias("company_slug"))


def _best_by_url(urls: DataFrame, sizes: DataFrame) -> DataFrame:
    """Latest profile whose slug occurs in the URL, for any number of slugs."""
    patterns = sizes.filter(F.col("company_slug") != "").withColumnRenamed("company_slug", "pattern")
    best = F.max(F.struct("profile_pos", "employee_count"))
    return substring_join(urls, patterns).groupBy("text").agg(best.alias("_by_url"))


def backfill_headcount(store: DataFrame, profiles: DataFrame, source: str) -> DataFrame:
    """`backfill_headcount`: write resolved sizes onto the postings of one source.

    A profile applies when its company name is equal or its slug occurs in the
    URL; the last profile (profile_pos) that applies wins.
    """
    sizes = profiles.filter(F.col("employee_count") != fixed.NOT_AVAILABLE).select(
        F.lower("company_slug").alias("company_slug"),
        "company_name",
        "employee_count",
        "profile_pos",
    )
    latest = F.max(F.struct("profile_pos", "employee_count"))
    by_name = sizes.groupBy("company_name").agg(latest.alias("_by_name"))
    by_slug = sizes.groupBy("company_slug").agg(latest.alias("_s")).select(
        "company_slug", "_s.*"
    )
    selected = F.col("source_website") == source
    text = F.when(selected, F.lower("job_url"))
    keyed = store.withColumn("text", text)
    marked = lookup_join(keyed, by_name, ["company_name"])

    urls = keyed.filter(F.col("text").isNotNull()).select("text").distinct()
    marked = lookup_join(marked, _best_by_url(urls, by_slug), ["text"])
    best = F.when(selected, F.greatest("_by_name", "_by_url"))
    people = F.coalesce(best["employee_count"], F.col("number_of_people"))
    return marked.withColumn("number_of_people", people).select(*store.columns)


def backfill_published(store: DataFrame, feed: DataFrame, as_of) -> DataFrame:
    """`backfill_published`: publication time and label from a feed.

    A feed row applies when its URL is equal or its company and role are equal;
    the last one in feed order wins.
    """
    usable = feed.filter(F.col("published_at").isNotNull() & (F.col("job_url") != ""))
    latest = F.max(F.struct("ingest_pos", "published_at"))
    by_url = usable.groupBy("job_url").agg(latest.alias("_u"))
    by_names = usable.groupBy("company_name", "job_role").agg(latest.alias("_n"))
    joined = lookup_join(store, by_url, ["job_url"])
    joined = lookup_join(joined, by_names, ["company_name", "job_role"])
    raw = F.greatest("_u", "_n")["published_at"]
    staged = joined.withColumn("_raw", raw)
    return staged.withColumns(
        {
            "published_at": F.coalesce(normalize_published(F.col("_raw")), "published_at"),
            "posted_date": F.when(
                F.col("_raw").isNotNull(), age_label_fine(from_source(F.col("_raw")), as_of)
            ).otherwise(F.col("posted_date")),
        }
    ).select(*store.columns)


def with_headcount(df: DataFrame) -> DataFrame:
    """Add number_of_people, the `parse_headcount` of employee_count_raw.

    The stripped text is a column of its own, so Spark compiles the rules instead of interpreting them in a lambda.
    """
    stripped = df.withColumn("_headcount", strip_name(F.col("employee_count_raw")))
    return stripped.withColumn("number_of_people", F.expr(headcount_sql("_headcount"))).drop("_headcount")
