"""Next-page links and traversal of a stored page corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.let import let
from jobsieve.functions.text import strip
from jobsieve.functions.urls import host_of, in_scope, query_pairs
from jobsieve.operators.spread import first_by, lookup_join
from jobsieve.session import ready_for_checkpoint
from jobsieve.sources.extract import TIERS, tiered
from jobsieve.sources.markup import resolve_url
from jobsieve.sources.parts import LINKS, page_parts



def _following_page(url: Column) -> Column:
    """The same URL with its page parameter raised by one."""
    pairs = F.transform(
        query_pairs(url),
        lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")),
    )
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.+)$", 1)

    def build(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["key"]))
        page = F.get(F.filter(ps, lambda p: p["key"] == "page"), F.lit(0))["value"]
        number = F.coalesce(strip(page).try_cast("long"), F.lit(1)) + 1
        ordered = F.flatten(
            F.transform(
                F.when(F.array_contains(keys, "page"), keys).otherwise(
                    F.array_append(keys, "page")
                ),
                lambda k: F.when(
                    k == "page", F.array(F.concat(F.lit("page="), number.cast("string")))
                ).otherwise(
                    F.transform(
                        F.filter(ps, lambda p: p["key"] == k),
                        lambda p: F.concat(
                            F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])
                        ),
                    )
                ),
            )
        )
        return F.concat(base, F.lit("?"), F.array_join(ordered, "&"), fragment)

    return let(pairs, build)


def _valid_next(candidate: Column, current: Column) -> Column:
    def bare(u: Column) -> Column:
        return F.rtrim(F.split_part(u, F.lit("#"), F.lit(1)), F.lit("/"))

    return (
        (candidate != "")
        & (bare(candidate) != bare(current))
        & (host_of(candidate) == host_of(current))
    )


def next_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, candidates): the possible next URLs of each page, best first.

    Order: rel=next, aria-label, link text, script button.  Link texts inside
    pagination blocks are link texts already, so they need no rule of their own.
    """
    return _candidates(page_parts(pages, LINKS))


def _candidates(rows: DataFrame) -> DataFrame:
    url = F.col("url")
    found = rows.select(
        "page_id",
        "url",
        F.concat(
            F.transform("others", lambda h: resolve_url(url, h)),
            F.when(F.col("button"), F.array(_following_page(url))).otherwise(F.array().cast("array<string>")),
        ).alias("candidates"),
    )
    valid = F.filter("candidates", lambda c: _valid_next(c, F.col("url")))
    return found.withColumn("candidates", valid)


def next_page_link(pages: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """`next_page_link`: the best candidate of each page that was not visited yet."""
    ranked = next_candidates(pages).select(
        "page_id", F.col("url").alias("page_url"), F.posexplode("candidates").alias("rank", "url")
    )
    if visited is not None:
        ranked = ranked.join(visited.select("url").distinct(), "url", "left_anti")
    best = ranked.groupBy("page_id", "page_url").agg(F.min_by("url", "rank").alias("next_url"))
    return best


def traverse_pages(
    pages: DataFrame,
    start_urls: DataFrame,
    max_pages: int,
    max_records: int | None = None,
    max_empty: int = fixed.EMPTY_PAGES_STOP,
) -> DataFrame:
    """`traverse_pages`: follow next links from each start URL through the stored pages.

    A chain ends without a next link in scope, at a page that is not stored,
    after ``max_pages`` pages, at ``max_records`` records if given, or after
    ``max_empty`` pages in a row without records.  Returns (start_url, page_no,
    url, records).

    Every page is parsed once.  The chains that go on advance together, one lookup per
    round in which a page that many of them share is split; those that have ended leave the loop.
    A chain carries its visited pages, which max_pages bounds.  Every round is checkpointed, so a lost executor
    repeats one.
    """
    ready_for_checkpoint(pages.sparkSession)
    rows = page_parts(pages, LINKS, *TIERS).checkpoint()
    records = tiered(rows.filter(F.col("tier") != LINKS)).groupBy("page_id").agg(F.count(F.lit(1)).alias("records"))
    steps = (
        _candidates(rows.filter(F.col("tier") == LINKS))
        .join(records, "page_id", "left")
        .select(
            "page_id",
            F.col("url").alias("at_url"),
            "candidates",
            F.coalesce("records", F.lit(0)).alias("found"),
        )
    )
    steps = first_by(steps, ["at_url"], "page_id").drop("page_id").checkpoint()

    going = start_urls.select(
        F.col("url").alias("start_url"),
        F.col("url").alias("at_url"),
        F.lit(0).cast("long").alias("records"),
        F.lit(0).alias("empty"),
        F.array().cast("array<struct<url:string,records:bigint>>").alias("visits"),
    ).distinct()
    ended = []
    for _ in range(max_pages):
        moved = _advance(going, steps, max_records, max_empty).checkpoint()
        ended.append(moved.filter(F.col("at_url").isNull()))
        going = moved.filter(F.col("at_url").isNotNull())
        if going.isEmpty():
            break
    chains = reduce(DataFrame.union, ended, going)
    visits = chains.select("start_url", F.posexplode("visits").alias("page_no", "visit"))
    return visits.select("start_url", F.col("page_no") + 1, "visit.url", "visit.records").toDF(
        "start_url", "page_no", "url", "records"
    )


def _advance(
    chains: DataFrame, steps: DataFrame, max_records: int | None, max_empty: int
) -> DataFrame:
    """Visit the current page of every active chain and choose the next one."""
    visit = F.struct(F.col("at_url").alias("url"), F.col("found").alias("records"))
    here = F.col("found").isNotNull()
    visited = lookup_join(chains, steps, ["at_url"]).select(
        "start_url",
        "at_url",
        "candidates",
        (F.col("records") + F.coalesce("found", F.lit(0))).alias("records"),
        F.when(F.col("found") == 0, F.col("empty") + 1).otherwise(0).alias("empty"),
        F.when(here, F.array_append("visits", visit)).otherwise(F.col("visits")).alias("visits"),
    )
    seen = F.transform("visits", lambda v: v["url"])
    unseen = F.filter(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: ~F.array_contains(seen, c))
    target = F.get(unseen, F.lit(0))
    goes_on = F.col("empty") < max_empty
    if max_records is not None:
        goes_on = goes_on & (F.col("records") < max_records)
    staged = visited.withColumn("target", target)
    return staged.select(
        "start_url",
        F.when(goes_on & in_scope(F.col("target"), F.col("start_url")), F.col("target")).alias(
            "at_url"
        ),
        "records",
        "empty",
        "visits",
    )
