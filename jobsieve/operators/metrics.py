"""Summaries and counters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.dates import date_tab, is_new_today
from jobsieve.functions.headcount import size_bucket, size_eligible
from jobsieve.functions.let import once
from jobsieve.functions.text import normalize_key
from jobsieve.operators.classify import eligible_sizes, keyword_hits
from jobsieve.operators.dedupe import with_dedupe_key
from jobsieve.operators.enrich import with_headcount
from jobsieve.operators.filters import with_validity
from jobsieve.operators.rules import KeywordRule, default_keyword_rules, rules_frame


def _count() -> object:
    return F.count(F.lit(1))


def store_stats(store: DataFrame, as_of) -> DataFrame:
    """`store_stats`: totals, first seen today, exact companies, rows per source."""
    source = F.lower("source_website")
    feed_a = F.count_if(F.contains(source, F.lit(fixed.FEED_A_SOURCE)))
    feed_b = F.count_if(F.contains(source, F.lit(fixed.FEED_B_SOURCE)))
    return store.agg(
        _count().alias("total_jobs"),
        F.count_if(is_new_today(F.col("first_seen_at"), as_of)).alias("new_today"),
        F.count_distinct("company_name").alias("total_companies"),
        feed_b.alias("feed_b_jobs"),
        feed_a.alias("feed_a_jobs"),
        F.greatest(F.lit(0), _count() - feed_a - feed_b).alias("other_jobs"),
    )


def run_stats(rows: DataFrame, order: str = "ingest_pos") -> DataFrame:
    """`run_stats`: the counters of one run, from its raw rows with cleaned names and is_new.

    One scan and one shuffle: postings and pages are grouped by their keys together, each posting key keeps its
    first arrival and the number of its rows, and only first arrivals meet the rules for size and names.
    Missing headcounts are counted once, after the size gate, for every source.
    """
    keyed = with_dedupe_key(rows)
    value = F.struct("company_name", "job_role", "employee_count_raw", "is_new")
    entries = F.array(
        F.struct(F.lit(True).alias("posting"), F.col("dedupe_key").alias("key"), F.col(order).alias("at"), value.alias("value")),
        F.struct(F.lit(False).alias("posting"), F.col("page_url").alias("key"), F.lit(None).alias("at"), F.lit(None).alias("value")),
    )
    grouped = keyed.select(F.inline(entries)).groupBy("posting", "key").agg(_count().alias("n"), F.min_by("value", "at").alias("first"))
    firsts = with_headcount(grouped.select("posting", "key", "n", "first.*"))
    staged = with_validity(firsts.withColumn("is_eligible", size_eligible(F.col("number_of_people"))))
    posting = F.col("posting")
    sized = posting & F.col("is_eligible")
    processed = sized & F.col("is_valid")
    missing = F.trim("number_of_people").isin(*fixed.SIZE_MISSING_STAT)
    flagged = staged.select(
        "posting", "key", "n", "is_new", processed.alias("processed"), (sized & missing).alias("missing"),
        F.when(processed, normalize_key(F.col("company_name"))).alias("company"),
    )
    return flagged.agg(
        F.count_if(~posting & F.col("key").isNotNull()).alias("pages_processed"),
        F.coalesce(F.sum(F.when(posting, F.col("n"))), F.lit(0)).alias("jobs_discovered"),
        F.count_if("processed").alias("jobs_processed"),
        F.count_distinct("company").alias("companies_discovered"),
        F.coalesce(F.sum(F.when(posting, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count_if("missing").alias("missing_employee_counts"),
        F.count_if(F.col("processed") & F.col("is_new")).alias("new_jobs_added"),
        F.count_if(F.col("processed") & ~F.col("is_new")).alias("existing_jobs_seen"),
    )


def _first_flag(df: DataFrame, flag: str, order: str) -> Column:
    """The 0/1 flag of the row with the smallest order; packed into one long where the order is an integer."""
    if df.schema[order].dataType.typeName() in ("long", "integer", "short", "byte"):
        return F.pmod(F.min(F.col(order) * 2 + F.col(flag)), F.lit(2))
    return F.min_by(flag, order)


def category_counts(
    df: DataFrame, rules: Iterable[KeywordRule] | None = None, order: str = "ingest_pos"
) -> DataFrame:
    """Total and under-100 postings per keyword and per category (null keyword).

    Per keyword every posting counts, per category each (lower company, lower role) counts once and
    its first arrival decides the size.  Postings are added up by that pair first; the rules look at the role
    only, so each pair is matched once, and what is left to add up is one row per pair and keyword.
    """
    small = F.col("_small").cast("long")
    narrow = eligible_sizes(df).select(
        F.lower("company_name").alias("_company"), F.lower("job_role").alias("job_role"), small.alias("_small"), order
    )
    pairs = narrow.groupBy("_company", "job_role").agg(
        _count().alias("_n"), F.sum("_small").alias("_n_small"), _first_flag(narrow, "_small", order).alias("_first")
    )
    hits = keyword_hits(pairs.select("job_role", "_n", "_n_small", "_first"), rules)
    lead = F.col("_hit.lead")
    per_keyword = hits.groupBy("_hit.hit.category_id", "_hit.hit.keyword_pos", "_hit.hit.keyword").agg(
        F.sum("_n").alias("total_jobs"), F.sum("_n_small").alias("under_100_jobs"),
        F.count_if(lead).alias("_pairs"), F.sum(F.when(lead, F.col("_first")).otherwise(0)).alias("_pairs_small"),
    )
    # one row per keyword is left; a pair leads once in each category that it hits
    both = F.array(
        F.struct("keyword_pos", "keyword", "total_jobs", "under_100_jobs"),
        F.struct(F.lit(None).alias("keyword_pos"), F.lit(None).alias("keyword"), F.col("_pairs").alias("total_jobs"), F.col("_pairs_small").alias("under_100_jobs")),
    )
    return per_keyword.select("category_id", F.inline(both)).groupBy("category_id", "keyword_pos", "keyword").agg(
        F.sum("total_jobs").alias("total_jobs"), F.sum("under_100_jobs").alias("under_100_jobs")
    )


def category_overview(
    df: DataFrame, rules: Iterable[KeywordRule] | None = None, order: str = "ingest_pos"
) -> DataFrame:
    """`category_overview`: counts per category and keyword, zero rows kept.

    The row of the category itself has keyword_pos -1 and keyword '(all)'.
    """
    rules = default_keyword_rules() if rules is None else list(rules)
    spark = df.sparkSession
    levels = {(r.category_id, r.category_name): None for r in rules}
    whole = [KeywordRule(c, n, -1, "(all)", ()) for c, n in levels]
    every = rules_frame(spark, [*whole, *rules])
    counts = category_counts(df, rules, order).select(
        "category_id",
        F.coalesce("keyword_pos", F.lit(-1)).alias("keyword_pos"),
        "total_jobs",
        "under_100_jobs",
    )
    # at most one row per rule on both sides
    joined = every.join(counts, ["category_id", "keyword_pos"], "left")
    return joined.select(
        "category_id",
        "category_name",
        "keyword_pos",
        "keyword",
        F.coalesce("total_jobs", F.lit(0)).alias("total_jobs"),
        F.coalesce("under_100_jobs", F.lit(0)).alias("under_100_jobs"),
    )


def category_summary(
    df: DataFrame,
    rules: Iterable[KeywordRule] | None,
    category: str,
    order: str = "ingest_pos",
) -> DataFrame:
    """`category_summary`: labelled counts of one category, two rows per keyword."""
    rules = default_keyword_rules() if rules is None else list(rules)
    chosen = [r for r in rules if r.category_id == category]
    counts = category_overview(df, chosen, order)
    whole = F.col("keyword_pos") == -1
    rows = F.array(
        F.struct(
            (F.col("keyword_pos") * 2 + 2).alias("line"),
            F.when(whole, F.lit("Total Jobs in Category"))
            .otherwise(F.concat("keyword", F.lit(" (Total)")))
            .alias("metric"),
            F.col("total_jobs").alias("value"),
        ),
        F.struct(
            (F.col("keyword_pos") * 2 + 3).alias("line"),
            F.when(whole, F.lit("Jobs with <100 Employees"))
            .otherwise(F.concat("keyword", F.lit(" (<100 People)")))
            .alias("metric"),
            F.col("under_100_jobs").alias("value"),
        ),
    )
    return counts.select(F.inline(rows)).orderBy("line")


def applications_stats(apps: DataFrame) -> DataFrame:
    """`applications_stats`: applications per role category, most first, with the total."""
    per = apps.groupBy("role_category").agg(_count().alias("applications"))
    total = F.lit(None).cast("string")
    whole = per.agg(F.coalesce(F.sum("applications"), F.lit(0)).alias("applications"))
    rows = per.select("role_category", "applications", F.lit(1).alias("level")).unionByName(
        whole.select(total.alias("role_category"), "applications", F.lit(0).alias("level"))
    )
    return rows.orderBy("level", F.desc("applications"), "role_category")


def applications_summary(apps: DataFrame) -> DataFrame:
    """`applications_summary`: count and last application per category, and TOTAL."""
    rolled = apps.rollup("role_category").agg(
        F.grouping("role_category").alias("_total"),
        _count().alias("applications"),
        F.max("applied_at").alias("_last"),
    )
    total = F.col("_total") == 1
    return rolled.orderBy("_total", "role_category").select(
        F.when(total, F.lit("TOTAL")).otherwise(F.col("role_category")).alias("role_category"),
        "applications",
        F.when(~total, F.col("_last")).alias("last_applied_at"),
    )


def master_summary(df: DataFrame, source_url: str, as_of, pages: int = 0) -> DataFrame:
    """`master_summary`: the eleven key/value rows of the master export."""
    buckets = df.withColumn("_sizes", size_bucket(F.col("number_of_people")))
    small, medium, large = fixed.SIZE_BUCKETS

    def in_bucket(name: str):
        return F.coalesce(F.array_contains("_sizes", name), F.lit(False))

    missing = F.trim("number_of_people").isin(*fixed.SIZE_MISSING_STAT)
    counts = buckets.agg(
        _count().alias("total"),
        F.count_if("is_new").alias("new"),
        F.count_if(~F.col("is_new")).alias("existing"),
        F.count_if(in_bucket(small)).alias("small"),
        F.count_if(in_bucket(medium)).alias("medium"),
        F.count_if(in_bucket(large)).alias("large"),
        F.count_distinct(F.lower("company_name")).alias("companies"),
        F.count_if(missing).alias("missing"),
    )
    lines = [
        ("Source URL", F.lit(source_url)),
        ("Extraction Date (UTC)", F.lit(str(as_of))),
        ("Total Jobs Extracted", F.col("total")),
        ("New Jobs Added Today", F.col("new")),
        ("Existing Jobs Retained", F.col("existing")),
        ("Small Companies (1-50 employees)", F.col("small")),
        ("Medium Companies (50-500 employees)", F.col("medium")),
        ("Large Companies (500+ employees)", F.col("large")),
        ("Unique Companies Found", F.col("companies")),
        ("Employee Counts Missing (N/A)", F.col("missing")),
        ("Pages Processed", F.lit(pages)),
    ]
    rows = [
        F.struct(
            F.lit(i).alias("line"), F.lit(key).alias("metric"), value.cast("string").alias("value")
        )
        for i, (key, value) in enumerate(lines, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def master_companies(df: DataFrame) -> DataFrame:
    """`master_companies`: distinct companies, ignoring case."""
    return df.agg(F.count_distinct(F.lower("company_name")).alias("companies"))


def date_tab_counts(df: DataFrame) -> DataFrame:
    """`date_tab_counts`: rows per date tab, ordered by the tab's earliest row."""
    return (
        df.withColumn("date_tab", date_tab(F.col("first_seen_at")))
        .groupBy("date_tab")
        .agg(_count().alias("rows"), F.min("first_seen_at").alias("earliest"))
        .orderBy(F.asc_nulls_first("earliest"))
    )


def distinct_sizes(df: DataFrame) -> DataFrame:
    """`distinct_sizes`: sorted headcount labels other than N/A."""
    people = F.col("number_of_people")
    # the label is kept, or the filter would move below the joins and parse it once more
    sizes = once(df.select("number_of_people"), number_of_people=people).filter((people != "") & (people != fixed.NOT_AVAILABLE))
    return sizes.select("number_of_people").distinct().orderBy("number_of_people")


def distinct_categories(df: DataFrame) -> DataFrame:
    """`distinct_categories`: role categories present in the feed."""
    category = F.coalesce(F.nullif("role_category", F.lit("")), F.lit(fixed.OTHER_ROLE))
    return df.select(category.alias("role_category")).distinct()


def run_rates(runs: DataFrame) -> DataFrame:
    """`run_rates`: jobs per minute (0 in the first three seconds) and percent new.

    Half values round up, as Math.round does.
    """
    jobs, seconds = F.col("jobs_processed"), F.col("elapsed_seconds")
    per_minute = F.floor(jobs / F.nullif(seconds, F.lit(0)) * 60 + 0.5)
    share = F.floor(
        F.coalesce("new_jobs_added", "jobs_processed") / F.greatest(jobs, F.lit(1)) * 100 + 0.5
    )
    slow = (seconds < 3) | (F.coalesce(jobs, F.lit(0)) == 0)
    return runs.withColumns(
        {
            "jobs_per_minute": F.when(slow, F.lit(0).cast("long")).otherwise(per_minute),
            "new_percent": share,
        }
    )
