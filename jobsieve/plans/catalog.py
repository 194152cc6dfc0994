"""Named queries over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobsieve import fixed, schema
from jobsieve.functions import dates, headcount, labels, predicates, text, urls
from jobsieve.operators import (
    classify,
    dedupe,
    enrich,
    filters,
    metrics,
    route,
    store,
    topk,
)
from jobsieve.operators.rules import default_keyword_rules, terms_frame
from jobsieve.plans import views
from jobsieve.plans.curation import curate
from jobsieve.session import new_path
from jobsieve.sources import extract, feeds, links
from jobsieve.streaming import deltas, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = views.AS_OF


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _add(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: dates.stamp(F.col(n)) for n in names})


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What curation reads of the raw postings; a first arrival is shuffled with all its columns."""
    return views.raw_postings(spark, sf_dir).select(
        "row_key", "company_name", "job_role", "employee_count_raw", "job_url", "ingest_pos"
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings cleaned and with a headcount."""
    return views.postings(spark, sf_dir).select(
        "row_key", "company_name", "job_role", "number_of_people", "job_url", "ingest_pos"
    )


# --- flagship ----------------------------------------------------------------


@query("curated_overview")
def curated_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate(_raw(spark, sf_dir))
    sized = enrich.enrich_headcount(rows, views.profiles(spark, sf_dir))
    return metrics.category_overview(sized)


# --- stored rows ---------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after merging the rows that are already stored."""
    rows = views.postings(spark, sf_dir).filter("stored")
    return store.upsert_postings(rows, store.empty_store(spark), views.STORED_AT)[0]


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).filter(~F.col("stored"))


def _store_view(df: DataFrame) -> DataFrame:
    return _stamped(df, "first_seen_at", "last_seen_at")


@query("upsert_postings")
def upsert_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = store.upsert_postings(_batch(spark, sf_dir), _store(spark, sf_dir), AS_OF)[0]
    return _store_view(merged)


@query("upsert_delta")
def upsert_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = store.upsert_postings(_batch(spark, sf_dir), _store(spark, sf_dir), AS_OF)[1]
    return _stamped(delta, "first_seen_at")


@query("new_vs_existing")
def new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = store.with_fingerprint(views.postings(spark, sf_dir).filter("stored"))
    split = store.new_vs_existing(_batch(spark, sf_dir), known)
    return split.select("row_key", "fingerprint", "is_new")


@query("write_snapshot")
def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshot")
    store.write_snapshot(_store(spark, sf_dir), path, 1)
    return _store_view(store.read_snapshot(spark, path, 1))


@query("align_schema")
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older store: no location, posted_by or posted_date, Unix publication times."""
    rows = store.with_fingerprint(views.postings(spark, sf_dir))
    older = rows.select(
        "fingerprint", "job_url", "company_name", "job_role", "number_of_people",
        "source_website", "first_seen_at", F.col("first_seen_at").alias("last_seen_at"),
        F.lit(1).cast("long").alias("scrape_count"),
        (F.col("ingest_pos.l_orderkey") * 3600 + 900000000).alias("published_at"),
    )
    return _store_view(store.align_schema(older))


@query("scan_postings")
def scan_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.scan_postings(views.postings(spark, sf_dir), "JOBS.%.com")
    return rows.select("row_key", "company_name", "source_website")


@query("scan_profiles")
def scan_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.scan_profiles(views.profiles(spark, sf_dir))


@query("lookup_profile")
def lookup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.lookup_profile(views.profiles(spark, sf_dir), " Supplier-000000005 ")


@query("master_postings")
def master_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = store.master_postings(
        views.postings(spark, sf_dir), views.profiles(spark, sf_dir), AS_OF, "himalayas"
    )
    return view.select(
        "row_key", "company_name", "job_role", "number_of_people", "posted_date", "location",
        "posted_by", "is_new_today",
    )


@query("enrich_headcount")
def enrich_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.enrich_headcount(views.postings(spark, sf_dir), views.profiles(spark, sf_dir))
    return rows.select("row_key", "number_of_people")


@query("attach_company_size")
def attach_company_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.attach_company_size(
        views.feed_rows(spark, sf_dir), views.profiles(spark, sf_dir)
    )
    return rows.select("row_key", "company_slug", "number_of_people")


@query("missing_profiles")
def missing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.missing_profiles(views.feed_rows(spark, sf_dir), views.profiles(spark, sf_dir))


@query("unsized_companies")
def unsized_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.unsized_companies(views.postings(spark, sf_dir), "himalayas.app")


@query("upsert_profiles")
def upsert_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.feed_rows(spark, sf_dir).select(
        "company_slug",
        F.when(F.col("stored"), F.col("company_name")).alias("company_name"),
        headcount.parse_headcount(F.col("employee_count_raw")).alias("employee_count"),
        "ingest_pos",
    )
    known = views.profiles(spark, sf_dir).drop("profile_pos")
    return _stamped(store.upsert_profiles(rows, known, AS_OF), "updated_at")


@query("backfill_headcount")
def backfill_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.backfill_headcount(
        views.postings(spark, sf_dir), views.profiles(spark, sf_dir), "himalayas.app"
    )
    return rows.select("row_key", "number_of_people")


@query("backfill_published")
def backfill_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.postings(spark, sf_dir)
    feed = rows.filter(~F.col("stored")).withColumn(
        "published_at", (F.col("ingest_pos.l_orderkey") * 3600 + 900000000).cast("string")
    )
    filled = enrich.backfill_published(rows.filter("stored"), feed, AS_OF)
    return filled.select("row_key", "published_at", "posted_date")


# --- run, dedupe, validation ------------------------------------------------------


@query("dedupe_postings")
def dedupe_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.dedupe_postings(_sized(spark, sf_dir))
    return rows.select("row_key", "company_name", "job_role", "job_url", "number_of_people")


@query("duplicates_count")
def duplicates_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicates_count(views.postings(spark, sf_dir))


@query("valid_record")
def valid_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.valid_record(views.postings(spark, sf_dir))
    return rows.select("row_key", "company_name", "job_role", "number_of_people")


@query("run_stats")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_stats(dedupe.with_clean_names(views.raw_postings(spark, sf_dir)))


@query("curated_postings")
def curated_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate(_raw(spark, sf_dir))
    return rows.select("row_key", "company_name", "job_role", "number_of_people")


# --- scalar functions over the postings ------------------------------------------


def _over_postings(name: str, build: Callable[[], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.postings(spark, sf_dir)
        return rows.select("row_key", *[c.alias(n) for n, c in build().items()])

    _add(name, run)


def _over_raw(name: str, build: Callable[[], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.raw_postings(spark, sf_dir)
        return rows.select("row_key", *[c.alias(n) for n, c in build().items()])

    _add(name, run)


_over_raw("clean_company", lambda: {"value": text.clean_company(F.col("company_name"))})
_over_raw("clean_role", lambda: {"value": text.clean_role(F.col("job_role"))})
_over_raw("valid_company", lambda: {"value": predicates.valid_company(F.col("company_name"))})
_over_raw("valid_role", lambda: {"value": predicates.valid_role(F.col("job_role"))})
_over_raw(
    "parse_headcount", lambda: {"value": headcount.parse_headcount(F.col("employee_count_raw"))}
)
_over_postings(
    "valid_headcount", lambda: {"value": predicates.valid_headcount(F.col("number_of_people"))}
)
_over_postings(
    "size_unspecified", lambda: {"value": headcount.size_unspecified(F.col("employee_count_raw"))}
)
_over_postings(
    "size_under_100",
    lambda: {
        "value": headcount.size_under_100(F.col("number_of_people")),
        "raw_value": headcount.size_under_100(F.col("employee_count_raw")),
    },
)
_over_postings(
    "size_bucket",
    lambda: {"value": F.array_join(headcount.size_bucket(F.col("number_of_people")), "|")},
)
_over_postings(
    "fingerprint",
    lambda: {
        "value": urls.fingerprint(F.col("company_name"), F.col("job_role"), F.col("job_url"))
    },
)
_over_postings("company_slug", lambda: {"value": urls.company_slug(F.col("company_name"))})
_over_postings("slug_from_url", lambda: {"value": urls.slug_from_url(F.col("job_url"))})
_over_postings(
    "age_label", lambda: {"value": dates.age_label(F.col("first_seen_at"), AS_OF)}
)
_over_postings(
    "age_label_iso",
    lambda: {"value": dates.age_label_iso(F.coalesce("published_at", F.lit("soon")), AS_OF)},
)
_over_postings(
    "posted_label",
    lambda: {
        "value": dates.posted_label(
            F.col("published_at"), F.col("posted_date"), F.col("first_seen_at"), AS_OF
        )
    },
)
_over_postings(
    "is_new_today", lambda: {"value": dates.is_new_today(F.col("first_seen_at"), AS_OF)}
)
_over_postings("date_tab", lambda: {"value": dates.date_tab(F.col("first_seen_at"))})
_over_postings("classify_role", lambda: {"value": classify.classify_role(F.col("job_role"))})
_over_postings(
    "posted_by_label",
    lambda: {
        "value": text.posted_by_label(
            F.col("posted_by"), F.nullif("location", F.lit("N/A")), F.col("company_name")
        )
    },
)


@query("split_compound")
def split_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("company_name", F.lit(" - "), "job_role")
    rows = labels.with_split_compound(views.postings(spark, sf_dir), line, "_split")
    return rows.select("row_key", "_split.company", "_split.role")


_over_postings(
    "split_metadata",
    lambda: {
        "value": labels.split_metadata(
            F.concat(F.lit("Remote · "), "job_role", F.lit(" • Full-time | "), "company_name"),
            F.col("job_role"),
        )
    },
)
_over_postings(
    "in_scope",
    lambda: {
        "own": urls.in_scope(F.col("job_url"), F.lit("https://example.com/")),
        "other": urls.in_scope(F.col("job_url"), F.col("source_website")),
    },
)


@query("size_eligible")
def size_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.eligible(views.postings(spark, sf_dir))
    return rows.select("row_key", "number_of_people")


# --- scalar functions over documents, pages, orders, events ------------------------


def _over_table(name: str, table: str, key: str, build: Callable[[], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.table(spark, sf_dir, table)
        return rows.select(key, *[c.alias(n) for n, c in build().items()])

    _add(name, run)


def _digest(c: Column) -> dict[str, Column]:
    return {"digest": F.md5(c), "length": F.length(c)}


_over_table(
    "clean_text", "documents", "doc_id", lambda: _digest(text.clean_text(F.col("text")))
)
_over_table(
    "clean_text_html", "pages", "page_id", lambda: _digest(text.clean_text(F.col("html")))
)
_over_table(
    "normalize_key", "documents", "doc_id", lambda: _digest(text.normalize_key(F.col("text")))
)
_over_table(
    "is_description",
    "documents",
    "doc_id",
    lambda: {"value": predicates.is_description(F.col("text"))},
)


def _sentences(spark: SparkSession, sf_dir: str, test: Callable[[Column], Column]) -> DataFrame:
    """The test on every sentence piece of every document, with a place name in front
    of the pieces, counted per document."""
    docs = views.table(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", F.explode(F.split("text", "[.,\n]")).alias("piece"))
    marked = pieces.select(
        "doc_id",
        test(F.col("piece")).alias("plain"),
        test(F.concat(F.lit("Remote, "), F.substring("piece", 1, 8))).alias("place"),
    )
    return marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.count_if("plain").alias("plain_hits"),
        F.count_if("place").alias("place_hits"),
    )


_add("is_location", lambda s, d: _sentences(s, d, predicates.is_location))
_add("is_noise", lambda s, d: _sentences(s, d, predicates.is_noise))
_over_table(
    "normalize_url", "pages", "page_id", lambda: {"value": urls.normalize_url(F.col("url"))}
)
_over_table("domain_of", "pages", "page_id", lambda: {"value": urls.domain_of(F.col("url"))})
_over_table(
    "feed_window_params",
    "pages",
    "page_id",
    lambda: {
        n: urls.feed_window_params(_feed_url())[n]
        for n in ("offset", "page", "keyword", "search_page")
    },
)


def _feed_url() -> Column:
    """A feed URL per page: plain, offset, keyword and path forms."""
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("https://feed.example.com/jobs?page="), n))
        .when(kind == 1, F.concat(F.lit("https://feed.example.com/jobs/data-engineer?offset="), n))
        .when(kind == 2, F.concat(F.lit("https://feed.example.com/jobs/api?q=a+b%20c&page="), n))
        .otherwise(F.col("url"))
    )


@query("feed_b_filters")
def feed_b_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    url = F.concat(
        F.lit("https://feed.example.com/search?skill=java&skill=a%20b&offset=20&page="),
        F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 2 == 0, F.lit("&industry_type=7&company_size=3")).otherwise(
            F.lit("&job_type=4")
        ),
    )
    return feeds.feed_b_filters(pages.select("page_id", url.alias("url"))).drop("url")


_over_table(
    "city_from_url",
    "pages",
    "page_id",
    lambda: {"city": urls.city_of_url(_city_url())},
)


def _city_url() -> Column:
    cities = F.lit(["pune", "new-delhi", "greater-noida", "at-acme-lima", "x-at-big-co-oslo", "zz"])
    tail = F.get(cities, (F.col("page_id") % 6).cast("int"))
    return F.concat("url", F.lit("/job-12-dev-"), tail, F.lit("/"))


_over_table(
    "job_id_from_url",
    "orders",
    "o_orderkey",
    lambda: {
        "job_id": urls.job_id_from_url(
            F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")),
            F.concat(F.lit("https://e.com/job-"), F.col("o_orderkey").cast("string"), F.lit("-x")),
        )
    },
)
_over_table(
    "format_count",
    "orders",
    "o_orderkey",
    lambda: {
        "value": text.format_count(
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") * 1237)
        ),
        "people": text.people_label(
            F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") * 100),
            F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")),
        ),
    },
)
_over_table(
    "safe_tab_title",
    "documents",
    "doc_id",
    lambda: {
        "title": text.safe_tab_title(F.concat(F.lit("a/b:[c]*?"), "text")),
        "category_title": text.safe_category_title(F.concat(F.lit("a/b:[c]*?"), "text")),
    },
)
_over_table(
    "parse_numeric_suffix",
    "orders",
    "o_orderkey",
    lambda: {
        "value": headcount.parse_numeric_suffix(
            F.concat(
                F.format_number(F.col("o_custkey"), 0),
                F.when(F.col("o_orderkey") % 2 == 0, F.lit(".25")).otherwise(F.lit("")),
                F.get(F.lit(["K", " m", "", "B", "x"]), (F.col("o_orderkey") % 5).cast("int")),
            )
        ).cast("long")
    },
)
_over_table(
    "profile_size_from_text",
    "orders",
    "o_orderkey",
    lambda: {
        "value": headcount.profile_size_from_text(
            F.concat(
                F.lit("# x\n\n**Size:** "),
                F.when(F.col("o_custkey") % 3 == 0, F.lit(" Unknown ")).otherwise(
                    F.concat(F.col("o_custkey").cast("string"), F.lit("-500"))
                ),
                F.lit("\n**Other:** 1"),
            )
        )
    },
)


def _published_text() -> Column:
    """Publication times in four spellings."""
    n = F.col("o_orderkey")
    seconds = n * 3600 + 900000000
    return (
        F.when(n % 5 == 0, seconds.cast("string"))
        .when(n % 5 == 1, (seconds * 1000).cast("string"))
        .when(n % 5 == 2, F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T23:30:00-02:00")))
        .when(n % 5 == 3, F.concat(F.lit(" "), F.col("o_orderdate").cast("date").cast("string")))
        .otherwise(F.concat(F.lit("soon "), n.cast("string")))
    )


_over_table(
    "normalize_published",
    "orders",
    "o_orderkey",
    lambda: {"value": dates.normalize_published(_published_text())},
)
_over_table(
    "source_age_label",
    "orders",
    "o_orderkey",
    lambda: {"value": dates.source_age_label(_published_text(), AS_OF)},
)
_over_table(
    "age_label_fine",
    "events",
    "event_id",
    lambda: {"value": dates.age_label_fine(F.col("ts"), views.EVENTS_AS_OF)},
)
_over_table(
    "age_label_ui",
    "events",
    "event_id",
    lambda: {"value": dates.age_label_ui(F.col("ts"), views.EVENTS_AS_OF)},
)
_over_table(
    "extraction_age",
    "orders",
    "o_orderkey",
    lambda: {"value": dates.extraction_age(F.col("o_orderdate"))},
)


# --- filters ----------------------------------------------------------------------


@query("source_filter")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.source_filter(views.postings(spark, sf_dir), "Instahyre")
    return rows.select("row_key", "source_website")


@query("engineering_filter")
def engineering_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed_a_postings(views.feed_a_bodies(spark, sf_dir)).withColumn(
        "categories",
        F.when(F.col("ingest_pos.page_pos") % 2 == 0, F.col("categories")),
    )
    kept = filters.engineering_filter(rows)
    return kept.select(F.col("ingest_pos.page_pos").alias("page_pos"), "job_role", "company_name")


@query("search_preview")
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.search_preview(
        views.postings(spark, sf_dir), "NEW", "1 - 10 employees", "DevOps"
    )
    return rows.select("row_key", "company_name", "job_role")


@query("search_stream")
def search_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.search_stream(views.postings(spark, sf_dir), "More Than")
    return rows.select("row_key", "number_of_people")


@query("search_feed")
def search_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.with_role_category(views.postings(spark, sf_dir))
    return filters.search_feed(rows, "Frontend", " ring ").select("row_key", "role_category")


@query("new_only")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.new_only(views.postings(spark, sf_dir)).select("row_key", "is_new")


@query("new_only_fallback")
def new_only_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.postings(spark, sf_dir).filter(~F.col("is_new"))
    return filters.new_only(rows).select("row_key", "is_new")


# --- classification and metrics -----------------------------------------------------


@query("keyword_match")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.keyword_match(views.postings(spark, sf_dir))
    return rows.select("row_key", "category_id", "keyword_pos", "keyword")


@query("keyword_match_table")
def keyword_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a table: the default ones, and one per nation, whose terms are the words of part names that start like it."""
    nations = views.table(spark, sf_dir, "nation").select(
        F.lit("nations").alias("category_id"), F.lit("Nations").alias("category_name"), F.col("n_nationkey").cast("int").alias("keyword_pos"),
        F.col("n_name").alias("keyword"), F.concat(F.lit(" "), F.substring("n_name", 1, 2), F.lit(" ")).alias("term"),
    )
    table = terms_frame(spark, default_keyword_rules()).unionByName(nations)
    rows = classify.keyword_match(views.postings(spark, sf_dir), table)
    return rows.select("row_key", "category_id", "keyword_pos", "keyword")


@query("distinct_in_category")
def distinct_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.distinct_in_category(classify.keyword_match(_sized(spark, sf_dir).drop("number_of_people", "job_url")))
    return rows.select("row_key", "category_id", "keyword", "company_name", "job_role")


@query("category_jobs")
def category_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.category_jobs(_sized(spark, sf_dir).drop("job_url"))
    return rows.select("row_key", "category_id", "keyword", "bucket", "number_of_people")


@query("category_overview")
def category_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_overview(views.postings(spark, sf_dir))


@query("category_summary")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_summary(views.postings(spark, sf_dir), None, "qa_automation")


@query("store_stats")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.store_stats(views.postings(spark, sf_dir), "2001-11-04 09:00:00")


@query("applications_stats")
def applications_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.applications_stats(_applications(spark, sf_dir)).drop("level")


@query("applications_summary")
def applications_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(metrics.applications_summary(_applications(spark, sf_dir)), "last_applied_at")


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.with_role_category(views.applications(spark, sf_dir))


@query("master_summary")
def master_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.master_summary(
        views.postings(spark, sf_dir), "Master Database Archive", AS_OF, 0
    )


@query("master_companies")
def master_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.master_companies(views.postings(spark, sf_dir))


@query("date_tab_counts")
def date_tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(metrics.date_tab_counts(views.postings(spark, sf_dir)), "earliest")


@query("distinct_sizes")
def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_sizes(views.postings(spark, sf_dir))


@query("distinct_categories")
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_categories(
        classify.with_role_category(views.postings(spark, sf_dir))
    )


@query("run_rates")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user of the event log."""
    runs = (
        views.table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("event_type") != "error").alias("jobs_processed"),
            F.count_if(F.col("event_type") == "signup").alias("new_jobs_added"),
            (F.count_if(F.col("event_type") == "click") % 40).alias("elapsed_seconds"),
        )
    )
    return metrics.run_rates(runs)


# --- top-k, windows, positions --------------------------------------------------------


@query("recent_postings")
def recent_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.recent_postings(
        views.postings(spark, sf_dir), 50, "himalayas", tie=["ingest_pos"]
    )
    return rows.select("row_key", "company_name", "job_role", "published_at", "role_category")


@query("search_roles")
def search_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_roles(views.postings(spark, sf_dir), "r_ng%dev", 50)


@query("preview_head")
def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.preview_head(views.postings(spark, sf_dir)).select("row_key", "company_name")


@query("recent_tail")
def recent_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.recent_tail(views.postings(spark, sf_dir)).select("row_key", "company_name")


@query("cap_records")
def cap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.cap_records(curate(_raw(spark, sf_dir)), 500).select(
        "row_key", "company_name"
    )


@query("sync_limit")
def sync_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.sync_limit(views.postings(spark, sf_dir), 120).select("row_key", "company_name")


@query("feed_offset_slice")
def feed_offset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.feed_offset_slice(views.raw_postings(spark, sf_dir), 40, 200, total=180)
    return rows.select("row_key", "company_name")


@query("position_slice_large")
def position_slice_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same slice beyond the top-k bound, where rows are numbered in parallel."""
    rows = topk.position_slice(views.raw_postings(spark, sf_dir), 3000, 10_000_000)
    return rows.select("row_key")


@query("early_stop_prefix")
def early_stop_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.raw_postings(spark, sf_dir)
    kept = topk.early_stop_prefix(rows, threshold=9, by="source_website")
    return kept.select("row_key", "source_website", "is_new")


@query("application_rownum")
def application_rownum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.application_rownum(_applications(spark, sf_dir))
    return rows.select("contact", "role_category", "row_number")


@query("batch_100")
def batch_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.route_date_tabs(views.raw_postings(spark, sf_dir))
    # numbered rows are shuffled and checkpointed with all their columns
    placed = topk.batch_100(rows.select("row_key", "date_tab", "ingest_pos"), "date_tab", n=10)
    return placed.select("row_key", "date_tab", "batch_no")


# --- export rows -------------------------------------------------------------------


@query("posting_row")
def posting_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.posting_row(views.postings(spark, sf_dir))


@query("export_name")
def export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.export_name(views.postings(spark, sf_dir), "Instahyre.com")


@query("category_export_name")
def category_export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = classify.keyword_match(views.postings(spark, sf_dir)).select("category_id").distinct()
    return hits.select(
        "category_id", route.category_export_name(F.col("category_id"), "himalayas").alias("name")
    )


@query("route_master_tabs")
def route_master_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.route_master_tabs(views.postings(spark, sf_dir)).select("row_key", "tab")


@query("route_category_tabs")
def route_category_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = route.route_category_tabs(_sized(spark, sf_dir).drop("job_url"), None, "qa_automation")
    return rows.select("row_key", "tab")


@query("route_application_tabs")
def route_application_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(route.route_application_tabs(_applications(spark, sf_dir)), "applied_at")


@query("route_date_tabs")
def route_date_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to one folder per tab and read back."""
    path = new_path(spark, "date-tabs")
    rows = route.route_date_tabs(views.postings(spark, sf_dir))
    route.write_tabs(rows.select("row_key", "date_tab"), path, "date_tab")
    return spark.read.schema("row_key string, date_tab string").parquet(path)


@query("write_application")
def write_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "applications")
    rows = views.applications(spark, sf_dir)
    first, second = rows.filter("job_url is null"), rows.filter("job_url is not null")
    route.write_application(first, path, views.STORED_AT)
    route.write_application(second, path, AS_OF)
    stored = spark.read.schema(schema.APPLICATIONS).parquet(path)
    return _stamped(stored, "applied_at").select(
        "name", "contact", "job_role", "company_name", "job_url", "role_category", "applied_at"
    )


# --- feeds ---------------------------------------------------------------------------


@query("feed_a_postings")
def feed_a_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed_a_postings(views.feed_a_bodies(spark, sf_dir))
    return rows.select(
        "ingest_pos.page_pos", "ingest_pos.at", "company_name", "job_role", "job_url",
        "company_slug", "published_at", "location", "source_website",
    )


def _feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_b_postings(views.feed_b_bodies(spark, sf_dir), AS_OF)


@query("feed_b_postings")
def feed_b_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_b(spark, sf_dir).select(
        "ingest_pos.page_pos", "ingest_pos.at", "company_name", "job_role", "employee_count_raw",
        "job_url", "job_id",
    )


@query("location_resolve")
def location_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_b(spark, sf_dir).select("ingest_pos.page_pos", "ingest_pos.at", "location")


@query("first_source_date")
def first_source_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_b(spark, sf_dir).select("ingest_pos.page_pos", "ingest_pos.at", "posted_date")


# --- pages ---------------------------------------------------------------------------


def _raw_view(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", "company_name", "job_role", "employee_count_raw", "job_url", "company_url",
        "page_url", "source_type",
    )


@query("scan_pages")
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.scan_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.md5("html").alias("digest"))


@query("extract_jsonld")
def extract_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(extract.extract_jsonld(views.part_pages(spark, sf_dir, views.JSON_LD)))


@query("extract_hydration")
def extract_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(extract.extract_hydration(views.part_pages(spark, sf_dir, views.HYDRATION)))


@query("extract_cards")
def extract_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(extract.extract_cards(views.part_pages(spark, sf_dir, views.CARDS)))


@query("extract_tables")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(extract.extract_tables(views.part_pages(spark, sf_dir, views.TABLES)))


@query("extract_detail")
def extract_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(extract.extract_detail(views.part_pages(spark, sf_dir, views.DETAIL)))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.part_pages(spark, sf_dir, views.MIXED)


@query("extract_tiered")
def extract_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.extract_tiered(_mixed(spark, sf_dir))
    return rows.select("page_id", "company_name", "job_role", "source_type")


@query("extract_stored_pages")
def extract_stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, whole, with job cards in their bodies."""
    rows = extract.extract_tiered(views.stored_pages(spark, sf_dir))
    return rows.select("page_id", "company_name", "job_role", "employee_count_raw", "source_type")


@query("curated_with_pages")
def curated_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run with pages: rows without a usable company completed from detail pages, others sized from company pages."""
    parts = views.table(spark, sf_dir, "part")
    lacking = F.col("p_size") > 25
    number = (F.col("p_partkey") % 40).cast("string")
    raw = parts.select(
        F.when(lacking, F.lit("Remote")).otherwise(F.concat(F.lit("Known "), number, F.lit(" Corp"))).alias("company_name"),
        F.concat(F.lit("Role "), "p_name").alias("job_role"),
        F.lit(None).cast("string").alias("employee_count_raw"),
        F.concat(F.expr(views.PART_URL), F.lit("/?ref=1")).alias("job_url"),
        F.concat(F.lit(f"{views.SITE}/company/"), number).alias("company_url"),
        F.lit(views.SITE).alias("page_url"),
        F.col("p_partkey").cast("long").alias("ingest_pos"),
    )
    company = F.expr(f"'{views.SITE}/company/' || CAST(s_suppkey AS string)")
    size = F.expr("'<html><b>Team size:</b> <i>' || CAST(s_suppkey * 7 AS string) || '</i></html>'")
    profiles = views.table(spark, sf_dir, "supplier").where("s_suppkey < 30").select(
        (-F.col("s_suppkey")).cast("long").alias("page_id"), company.alias("url"), size.alias("html")
    )
    rows = curate(raw, views.part_pages(spark, sf_dir, views.DETAIL).unionByName(profiles))
    return rows.select("ingest_pos", "company_name", "job_role", "number_of_people")


@query("union_tiers")
def union_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _mixed(spark, sf_dir)
    rows = topk.union_tiers(extract.extract_jsonld(pages), extract.extract_tables(pages))
    return rows.select("page_id", "company_name", "job_role", "source_type")


@query("follow_detail")
def follow_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without a usable company, completed from one detail page per part."""
    parts = views.table(spark, sf_dir, "part")
    raw = parts.select(
        F.col("p_partkey").alias("page_id"),
        F.when(F.col("p_size") > 25, F.lit("Remote")).otherwise(F.lit("Known Corp")).alias(
            "company_name"
        ),
        F.concat(F.lit("Role "), "p_name").alias("job_role"),
        F.concat(F.expr(views.PART_URL), F.lit("/?ref=1")).alias("job_url"),
        F.lit(None).cast("string").alias("company_url"),
        F.lit(views.SITE).alias("page_url"),
        F.lit(fixed.NOT_AVAILABLE).alias("number_of_people"),
        F.col("p_partkey").alias("ingest_pos"),
    )
    rows = extract.follow_detail(raw, views.part_pages(spark, sf_dir, views.DETAIL))
    return rows.select("page_id", "company_name", "job_role", "number_of_people")


@query("company_size_once")
def company_size_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company pages are one page per supplier."""
    suppliers = views.table(spark, sf_dir, "supplier")
    pages = suppliers.filter("s_suppkey % 4 <> 1").select(
        F.col("s_suppkey").alias("page_id"),
        F.expr("'https://jobs.example.com/company/' || " + views.SLUG).alias("url"),
        F.expr(
            "'<html><b>Team size:</b> <i>' || CAST(s_suppkey % 300 AS string) || '</i></html>'"
        ).alias("html"),
    )
    rows = enrich.company_size_once(views.postings(spark, sf_dir), pages)
    return rows.select("row_key", "company_name", "number_of_people")


@query("next_page_link")
def next_page_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.next_page_link(views.part_pages(spark, sf_dir, views.CARDS))


@query("unvisited")
def unvisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next links that are no stored list page."""
    found = links.next_page_link(views.part_pages(spark, sf_dir, views.CARDS))
    chain = views.chain_pages(spark, sf_dir)
    stored = chain.select(F.replace("url", F.lit("list?page="), F.lit("list?page=1")).alias("url"))
    return topk.unvisited(found.withColumnRenamed("next_url", "url"), stored).select(
        "page_id", "url"
    )


@query("traverse_pages")
def traverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every stored list page along its chain of at most ten pages."""
    pages = views.chain_pages(spark, sf_dir)
    return links.traverse_pages(pages, pages.select("url"), max_pages=8)


_STREAM_BATCHES = 3  # micro-batches of the streaming queries
_STREAM_FILES = 8  # files of each

# --- streaming -----------------------------------------------------------------------


def _order_stream(spark: SparkSession, sf_dir: str, backwards: bool = False) -> DataFrame:
    """The orders table as a stream of micro-batches, equal ranges of the key, some files each."""
    orders = views.table(spark, sf_dir, "orders")
    folder = new_path(spark, "orders-feed")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    number = F.expr(f"(o_orderkey - {low or 0}) * {_STREAM_BATCHES} div {(high or 0) - (low or 0) + 1}")
    for k in sorted(range(_STREAM_BATCHES), reverse=backwards):
        orders.where(number == k).repartition(_STREAM_FILES).write.mode("append").parquet(folder)
    return stream.stream_ingest(spark, folder, orders.schema, _STREAM_FILES, "parquet")


def _stream_postings(df: DataFrame) -> DataFrame:
    """Orders as postings: one company per customer, one role per priority."""
    return df.select(
        F.col("o_orderkey").alias("ingest_pos"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("company_name"),
        F.concat(F.lit("role "), F.col("o_orderpriority")).alias("job_role"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1 - 10 employees")).otherwise(
            F.lit("N/A")
        ).alias("number_of_people"),
        F.lit(None).cast("string").alias("job_url"),
        F.lit("himalayas.app").alias("source_website"),
        F.lit(None).cast("string").alias("posted_date"),
        F.col("o_orderdate").cast("string").alias("published_at"),
        F.lit("N/A").alias("location"),
        F.lit("N/A").alias("posted_by"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("company_slug"),
        F.expr("o_orderkey div 20").alias("page"),
    )


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all stored files and read what it wrote."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("stream_ingest")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drain(_stream_postings(_order_stream(spark, sf_dir)), "ingest")
    return rows.select("ingest_pos", "company_name", "job_role", "number_of_people")


@query("stream_dedupe")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals, although the latest arrive first."""
    path = new_path(spark, "dedupe")
    firsts = stream.stream_dedupe(_stream_postings(_order_stream(spark, sf_dir, backwards=True)))
    writer = firsts.writeStream.outputMode("update").foreachBatch(stream.emitted_batch(f"{path}/rows"))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = stream.settled(spark.read.schema(firsts.schema.add("batch", "long")).parquet(f"{path}/rows"))
    return rows.select("dedupe_key", "ingest_pos", "company_name", "job_role", "number_of_people")


@query("stream_upsert")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream-store")
    postings = _stream_postings(_order_stream(spark, sf_dir))
    stream.stream_upsert(postings, path, f"{path}/checkpoint", now=lambda batch_id: AS_OF).awaitTermination()
    rows = _store_view(deltas.read_store(spark, path))
    return rows.select(
        "fingerprint", "company_name", "job_role", "number_of_people", "published_at",
        "scrape_count", "first_seen_at",
    )


@query("stream_progress")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log after each micro-batch, over a store that an earlier run has filled with finished orders."""
    path = new_path(spark, "progress")
    finished = _stream_postings(views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"))
    stream.upsert_batch(path, lambda batch_id: AS_OF, run_id="earlier")(finished, 0)
    postings, run_id = _stream_postings(_order_stream(spark, sf_dir)), f"{path}/checkpoint"
    stream.stream_progress(postings, path, run_id, lambda batch_id: AS_OF, page="page").awaitTermination()
    line = F.transform("recent_jobs", lambda j: F.concat_ws("|", j.ingest_pos, j.company_name, j.job_role, j.number_of_people, j.is_new))
    return stream.progress_log(spark, path, run_id).withColumn("recent_jobs", F.array_join(line, ";"))


@query("profile_refresh")
def profile_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("company_slug"),
        F.when(
            F.col("c_nationkey") > 4,
            F.concat(F.lit("about\n**Size:** "), F.col("c_nationkey").cast("string"), F.lit("-50")),
        ).otherwise(F.lit("about")).alias("text"),
    )
    path = new_path(spark, "stream-profiles")
    run = stream.profile_refresh(
        _stream_postings(_order_stream(spark, sf_dir)),
        texts,
        path,
        f"{path}/checkpoint",
        now=lambda batch_id: AS_OF,
    )
    run.awaitTermination()
    return stream.latest_profiles(spark, path).select("company_slug", "company_name", "employee_count")
