"""Extraction tiers: stored pages (page_id, url, html) to raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jobsieve import fixed
from jobsieve.functions.headcount import parse_headcount
from jobsieve.functions.labels import metadata_segments, split_compound
from jobsieve.functions.let import let
from jobsieve.functions.predicates import (
    is_location,
    noise_sql,
    valid_company,
    valid_company_sql,
    valid_role,
)
from jobsieve.functions.text import clean_company, clean_label_sql, clean_role, clean_text_sql
from jobsieve.functions.urls import in_scope, normalize_url
from jobsieve.operators.spread import first_by, lookup_join, measured
from jobsieve.session import ready_for_checkpoint
from jobsieve.sources import parts
from jobsieve.sources.markup import resolve_url
from jobsieve.sources.parts import page_parts

_KINDS = {
    parts.JSON_LD: "json_ld", parts.HYDRATION: "hydration", parts.CARDS: "dom_card", parts.TABLES: "table",
    parts.DETAIL: "detail_page",
}
TIERS = (parts.JSON_LD, parts.HYDRATION, parts.CARDS, parts.TABLES)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """`scan_pages`: the stored page table."""
    return spark.read.parquet(path).select("page_id", "url", "html")


# --- JSON-LD -----------------------------------------------------------------


def _members(v: Column) -> Column:
    """Elements of a list, of a @graph, or the item itself."""
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.try_variant_get(v, "$['@graph']", "array<variant>"),
        F.array(v),
    )


def _string(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is_container(v: Column) -> Column:
    """A list, or an item with a @graph list."""
    return (
        F.try_variant_get(v, "$", "array<variant>").isNotNull()
        | F.try_variant_get(v, "$['@graph']", "array<variant>").isNotNull()
    )


def _opened(body: Column) -> Column:
    """All items of a script: its lists and @graphs are opened until none is left.

    A level of nesting costs a bracket, so there are at most as many steps as brackets; a step
    that finds nothing to open only looks.
    """
    def open_once(items: Column) -> Column:
        return F.when(F.exists(items, _is_container), F.flatten(F.transform(items, _members))).otherwise(items)

    level = F.array(F.try_parse_json(F.trim(body)))
    brackets = F.length(body) - F.length(F.translate(body, "[", ""))
    deeper = F.aggregate(F.sequence(F.lit(1), F.greatest(brackets, F.lit(1))), level, lambda items, _: open_once(items))
    return F.filter(deeper, lambda v: v.isNotNull())


def _with_items(rows: DataFrame) -> DataFrame:
    """One row per item of a script; rows of other tiers stay as they are."""
    script = F.col("tier") == parts.JSON_LD
    items = F.when(script, _opened(F.col("body"))).otherwise(F.array(F.lit(None).cast("variant")))
    opened = rows.select("*", F.posexplode(items).alias("item_no", "item")).drop("body")
    item = F.col("item")
    kinds = F.coalesce(
        F.array_join(F.try_variant_get(item, "$['@type']", "array<string>"), " "),
        _string(item, "$['@type']"),
    )
    jobs = opened.filter(~script | F.contains(F.lower(kinds), F.lit("jobposting"))).withColumns(
        {
            "org": F.try_variant_get(item, "$.hiringOrganization", "variant"),
            "people": F.try_variant_get(item, "$.hiringOrganization.numberOfEmployees", "variant"),
        }
    )
    org, people = F.col("org"), F.col("people")
    company = F.when(
        _kind(org).startswith("OBJECT"),
        F.coalesce(_string(org, "$.name"), _string(org, "$.legalName")),
    ).when(_kind(org) == "STRING", _string(org, "$"))
    size = F.when(
        _kind(people).startswith("OBJECT"),
        F.coalesce(F.try_variant_get(people, "$.value", "string"), F.lit("")),
    ).otherwise(F.try_variant_get(people, "$", "string"))
    read = {
        "company": company,
        "role": F.coalesce(_string(item, "$.title"), _string(item, "$.name")),
        "size": size,
        "job_url": F.coalesce(_string(item, "$.url"), F.nullif("url", F.lit(""))),
        "company_url": F.coalesce(_string(org, "$.sameAs"), _string(org, "$.url")),
        "at1": F.col("item_no").cast("long"),
    }
    none = F.lit(None).cast("string")
    named = jobs.withColumns({"job_url": none, "company_url": none})
    return named.withColumns({name: F.when(script, value).otherwise(F.col(name)) for name, value in read.items()}).drop(
        "item", "item_no", "org", "people"
    )


# --- cards -------------------------------------------------------------------


def _with_cards(rows: DataFrame) -> DataFrame:
    """Company, role, size and links of cards, from the texts of their elements; other tiers stay."""
    card = F.col("tier") == parts.CARDS
    read = rows.withColumn("split", F.when(card, split_compound(F.col("compound"))))
    read = read.withColumn("own_role", F.when(card, F.coalesce("split.role", clean_role(F.col("role")))))
    role = F.col("own_role")

    # company candidates in order of trust; one expression checks them all
    def candidate(text: Column, differs: bool, quiet: bool) -> Column:
        return F.struct(
            F.coalesce(text, F.lit("")).alias("text"), F.lit(differs).alias("differs"), F.lit(quiet).alias("quiet"), role.alias("role")
        )

    named = F.array(
        candidate(F.col("company"), False, False), candidate(F.col("company_link"), False, False), candidate(F.col("meta_inner"), True, False)
    )
    segments = F.transform(metadata_segments(F.coalesce("meta", F.lit(""))), lambda s: candidate(s, True, True))
    spans = F.transform("others", lambda s: candidate(s, True, False))
    # the rules use one-letter names of their own; k is not among them
    labelled = (
        f"k -> named_struct('text', {clean_label_sql('k.text')}, 'differs', k.differs, "
        "'quiet', k.quiet, 'role', k.role)"
    )
    usable = (
        f"k -> {valid_company_sql('k.text')} AND NOT (k.differs AND k.text <=> k.role) "
        f"AND NOT (k.quiet AND {noise_sql('k.text')})"
    )
    cleaned = F.call_function("transform", F.concat(named, segments, spans), F.expr(labelled))
    best = F.get(F.call_function("filter", cleaned, F.expr(usable)), F.lit(0))["text"]
    found = read.withColumn("own_company", F.when(card, F.coalesce("split.company", best)))
    kept = found.filter(~card | (F.coalesce(role, F.lit("")) != "") | F.col("own_company").isNotNull())
    badge = F.when((F.col("size") != "") & ~is_location(F.col("size")), F.col("size"))

    def href(name: str) -> Column:
        return F.when(F.col(name) != "", resolve_url(F.col("url"), F.col(name)))

    values = {
        "company": F.coalesce("own_company", F.lit("")), "role": F.coalesce(role, F.lit("")), "size": F.coalesce(badge, "mention"),
        "job_url": href("link"), "company_url": href("company_href"),
    }
    return kept.withColumns({name: F.when(card, value).otherwise(F.col(name)) for name, value in values.items()})


# --- records of all tiers ------------------------------------------------------


def _valid(candidate: Column) -> Column:
    """The cleaned candidate when it is a valid company."""
    return let(clean_company(candidate), lambda c: F.when(valid_company(c), c))


def _with_detail(rows: DataFrame) -> DataFrame:
    """Company and role of detail pages, which both have to be valid; other tiers stay."""
    detail = F.col("tier") == parts.DETAIL
    values = {
        "company": _valid(F.col("company")),
        "role": let(clean_role(F.col("role")), lambda r: F.when(valid_role(r), r)),
        "job_url": F.col("url"),
    }
    return rows.withColumns({name: F.when(detail, value).otherwise(F.col(name)) for name, value in values.items()})


def _records(rows: DataFrame, *tiers: int) -> DataFrame:
    """Raw postings from the page parts of some tiers; at most one pass over each part."""
    none = F.lit(None).cast("string")
    if parts.JSON_LD in tiers:
        rows = _with_items(rows)
    else:
        rows = rows.withColumns({"job_url": none, "company_url": none})
    if parts.CARDS in tiers:
        rows = _with_cards(rows)
    if parts.DETAIL in tiers:
        rows = _with_detail(rows)
    tier = F.col("tier")
    whole = tier.isin(parts.CARDS, parts.HYDRATION) | ((F.col("role") != "") & (F.col("company") != ""))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), tier)
    position = F.struct("page_id", "tier", "at0", "at1")
    return rows.filter(whole).select(
        position.alias("ingest_pos"), "page_id", F.col("company").alias("company_name"), F.col("role").alias("job_role"),
        F.col("size").alias("employee_count_raw"), "job_url", "company_url", F.col("url").alias("page_url"), kind.alias("source_type"),
    )


def _one_tier(pages: DataFrame, tier: int) -> DataFrame:
    return _records(page_parts(pages, tier), tier)


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """`extract_jsonld`: JobPosting items of the page's JSON-LD scripts.

    Lists and @graph are opened as deep as the JSON reader goes, 1,000 levels; other JSON is skipped.
    """
    scripts = F.regexp_extract_all("html", F.lit(parts.JSON_LD_SCRIPT), 1)
    found = pages.filter(F.contains("html", F.lit("ld+json"))).select("page_id", "url", F.posexplode(scripts).alias("at0", "body"))
    none = F.lit(None).cast("string")
    rows = found.select(
        "page_id", "url", F.lit(parts.JSON_LD).alias("tier"), F.col("at0").cast("long").alias("at0"), F.lit(0).cast("long").alias("at1"), "body",
        none.alias("company"), none.alias("role"), none.alias("size"),
    )
    return _records(rows, parts.JSON_LD)


def extract_hydration(pages: DataFrame) -> DataFrame:
    """`extract_hydration`: dicts of the embedded state that name a role and a company, at any depth."""
    return _one_tier(pages.filter(F.contains("html", F.lit("__NEXT_DATA__"))), parts.HYDRATION)


def extract_cards(pages: DataFrame) -> DataFrame:
    """`extract_cards`: fields of the repeated job cards of a page."""
    return _one_tier(pages, parts.CARDS)


def extract_tables(pages: DataFrame) -> DataFrame:
    """`extract_tables`: rows of tables whose header names a role and a company column."""
    return _one_tier(pages.filter(F.contains(F.lower("html"), F.lit("<th"))), parts.TABLES)


def tiered(rows: DataFrame) -> DataFrame:
    """Records of JSON-LD, hydration and cards; those of tables only on pages without any other.

    What is shuffled by page is the records, not the pages.
    """
    found = _records(rows, parts.JSON_LD, parts.CARDS)
    others = F.count_if(F.col("source_type") != "table").over(Window.partitionBy("page_id"))
    counted = found.withColumn("_others", others)
    return counted.filter((F.col("source_type") != "table") | (F.col("_others") == 0)).drop("_others")


def extract_tiered(pages: DataFrame) -> DataFrame:
    """`extract_tiered`: JSON-LD, hydration and cards; tables only for pages without any.

    Each page is parsed once, in one Arrow function.
    """
    return tiered(page_parts(pages, *TIERS))


# --- detail pages ----------------------------------------------------------------


def extract_detail(pages: DataFrame) -> DataFrame:
    """`extract_detail`: one record per detail page.

    The first JSON-LD item with valid names wins; else the h1 and a company
    element, which both have to be valid.
    """
    found = _records(page_parts(pages, parts.JSON_LD, parts.DETAIL), parts.JSON_LD, parts.DETAIL)
    valid = (F.col("source_type") == "detail_page") | (valid_company(F.col("company_name")) & valid_role(F.col("job_role")))
    return first_by(found.filter(valid), ["page_id"])


def wanted_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The first page of each key of ``keys`` (a _key per row, distinct), with that _key.

    If the keys' hashes are few enough for a broadcast, by their counted size, pages that no key names are left
    where they are read; what is shuffled is about the wanted pages.
    """
    named = pages.withColumn("_key", normalize_url(F.col("url")))
    hashes, small = measured(keys.select(F.xxhash64("_key").alias("_hash")).distinct())
    if small:
        named = named.withColumn("_hash", F.xxhash64("_key")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return first_by(named.join(keys, "_key", "left_semi"), ["_key"], "page_id")


def follow_detail(raw: DataFrame, pages: DataFrame, base: Column | None = None) -> DataFrame:
    """`follow_detail`: complete invalid rows from their detail page.

    Company and role are replaced; the headcount only while it is N/A.  Only
    pages that such a row points to are parsed.  The rows are checkpointed once they are tested; only
    incomplete ones meet the lookup, where a URL that many rows share is split.
    """
    ready_for_checkpoint(raw.sparkSession)
    site = F.col("page_url") if base is None else base
    incomplete = ~valid_company(F.col("company_name")) | ~valid_role(F.col("job_role"))
    follow = incomplete & (F.col("job_url") != "") & in_scope(F.col("job_url"), site)
    keyed = raw.withColumn("_key", F.when(follow, normalize_url(F.col("job_url")))).checkpoint()
    lacking = keyed.filter(F.col("_key").isNotNull())
    unique = wanted_pages(pages, lacking.select("_key").distinct())
    details = extract_detail(unique).select(
        normalize_url(F.col("page_url")).alias("_key"),
        clean_company(F.col("company_name")).alias("_company"),
        clean_role(F.col("job_role")).alias("_role"),
        F.col("company_url").alias("_company_url"),
        parse_headcount(F.col("employee_count_raw")).alias("_size"),
    )
    joined = lookup_join(lacking, details, ["_key"])
    na = fixed.NOT_AVAILABLE
    completed = joined.withColumns(
        {
            "company_name": F.coalesce("_company", "company_name"),
            "job_role": F.coalesce("_role", "job_role"),
            "company_url": F.coalesce("_company_url", "company_url"),
            "number_of_people": F.when(
                F.col("number_of_people") == na, F.coalesce("_size", "number_of_people")
            ).otherwise(F.col("number_of_people")),
        }
    ).select(*raw.columns)
    return keyed.filter(F.col("_key").isNull()).select(*raw.columns).unionByName(completed)
