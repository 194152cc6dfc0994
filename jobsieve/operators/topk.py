"""Ordering, limits, positions and prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from jobsieve import fixed
from jobsieve.functions.dates import stamp
from jobsieve.operators.classify import with_role_category
from jobsieve.operators.filters import like_any, source_filter
from jobsieve.operators.spread import lookup_join, measured, with_position

TOP_ROWS = 100_000  # largest offset + limit that one top-k task should hold
_BLOCK = 100_000  # rows per block when looking for streaks


def recent_postings(
    store: DataFrame,
    k: int = 20,
    source: str = fixed.FEED_A_SOURCE,
    tie: Sequence[str] = ("fingerprint",),
) -> DataFrame:
    """`recent_postings`: the k most recently published postings with role category."""
    when = F.coalesce("published_at", stamp(F.col("first_seen_at")))
    rows = source_filter(store, source).orderBy(F.desc(when), *[F.desc(c) for c in tie])
    return with_role_category(rows.limit(max(1, min(k, 50))))


def search_roles(store: DataFrame, q: str, k: int = 20) -> DataFrame:
    """`search_roles`: distinct (role, company, URL) of one feed whose role matches."""
    rows = store.filter(like_any("source_website", fixed.FEED_B_SOURCE))
    if q.strip():
        rows = rows.filter(like_any("job_role", q.strip()))
    keys = ("job_role", "company_name", "job_url")
    return with_role_category(rows.select(*keys).distinct().orderBy(*keys).limit(min(k, 50)))


def preview_head(df: DataFrame, n: int = fixed.RECENT_ROWS) -> DataFrame:
    """`preview_head`: the first n records in arrival order."""
    return df.orderBy("ingest_pos").limit(n)


def recent_tail(df: DataFrame, n: int = fixed.RECENT_ROWS) -> DataFrame:
    """`recent_tail`: the last n records, newest first."""
    return df.orderBy(F.desc("ingest_pos")).limit(n)


def _bounds(df: DataFrame, order: Column, *positions: int) -> list[Column | None]:
    """The ingest_pos at each position of an order, as literals; null where there are fewer rows.

    Only the positions themselves are sorted, over all tasks, and two values come back.
    """
    placed = with_position(df.select("ingest_pos"), [order], name="_position")
    found = {r["_position"]: r["ingest_pos"] for r in placed.filter(F.col("_position").isin(*positions)).collect()}
    kind = df.schema["ingest_pos"].dataType

    def literal(value) -> Column:
        if not isinstance(kind, T.StructType):
            return F.lit(value).cast(kind)
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])

    return [literal(found[p]) if p in found else None for p in positions]


def position_slice(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows offset+1 .. offset+limit in arrival order.

    Small windows use top-k.  A large LIMIT would gather its rows in one task; there the
    arrival positions at both ends are looked up, and the rows between them are filtered.
    """
    if offset + limit <= TOP_ROWS:
        return df.orderBy("ingest_pos").offset(offset).limit(limit)
    first, last = _bounds(df, F.asc("ingest_pos"), offset + 1, offset + limit)
    if first is None or limit == 0:
        return df.limit(0)
    rows = df.filter(F.col("ingest_pos") >= first)
    return rows if last is None else rows.filter(F.col("ingest_pos") <= last)


def cap_records(df: DataFrame, n: int) -> DataFrame:
    """`cap_records`: the first n kept records."""
    return position_slice(df, 0, n)


def sync_limit(df: DataFrame, n: int) -> DataFrame:
    """`sync_limit`: the n newest records, newest first; a large n is selected and sorted by many tasks."""
    newest = F.desc("ingest_pos")
    if n <= TOP_ROWS:
        return df.orderBy(newest).limit(n)
    (last,) = _bounds(df, newest, n)
    return (df if last is None else df.filter(F.col("ingest_pos") >= last)).orderBy(newest)


def feed_offset_slice(
    feed: DataFrame, offset: int, limit: int, total: int | None = None
) -> DataFrame:
    """`feed_offset_slice`: skip offset rows and stop at the reported total."""
    last = offset + limit if total is None else min(offset + limit, total)
    return position_slice(feed, offset, max(0, last - offset))


def early_stop_prefix(
    df: DataFrame, threshold: int = fixed.KNOWN_STREAK_STOP, by: str = "run"
) -> DataFrame:
    """`early_stop_prefix`: per run, keep rows up to the end of the first streak of
    ``threshold`` known rows.

    Only run, ingest_pos and is_new are numbered, in parallel.  Streaks are found in blocks of the numbering
    that overlap by threshold-1 rows, so a run of any size is split over tasks.  What comes back is the arrival
    position of each run's cut, so the rows themselves are only filtered.
    """
    placed = with_position(df.select(by, "ingest_pos", "is_new"), ["ingest_pos"], by=[by], name="_position")
    lead = threshold - 1
    block = F.floor((F.col("_position") - 1) / _BLOCK)
    reach = F.floor((F.col("_position") - 1 + lead) / _BLOCK)
    blocks = placed.select(
        by, "_position", "ingest_pos", "is_new", F.explode(F.sequence(block, reach)).alias("_block")
    )
    recent = Window.partitionBy(by, "_block").orderBy("_position").rowsBetween(-lead, 0)
    streaks = blocks.select(
        by,
        "ingest_pos",
        (F.count(F.lit(1)).over(recent) == threshold).alias("_full"),
        F.bool_or("is_new").over(recent).alias("_any_new"),
    )
    cuts = (
        streaks.filter(F.col("_full") & ~F.col("_any_new"))
        .groupBy(by)
        .agg(F.min("ingest_pos").alias("_cut"))
    )
    cuts, small = measured(cuts)
    joined = df.join(F.broadcast(cuts), by, "left") if small else lookup_join(df, cuts, [by])
    keep = F.col("_cut").isNull() | (F.col("ingest_pos") <= F.col("_cut"))
    return joined.filter(keep).select(*df.columns)


def application_rownum(apps: DataFrame, tie: Sequence[str] = ("contact",)) -> DataFrame:
    """`application_rownum`: 1-based number per role category in order of application.

    Applications of the same time and tie are told apart by all their columns, so that numbers do not change
    between runs.
    """
    rest = [c for c in apps.columns if c not in ("applied_at", "role_category", *tie)]
    return with_position(apps, ["applied_at", *tie, *rest], by=["role_category"], name="row_number")


def batch_100(
    df: DataFrame,
    by: str,
    n: int = fixed.SYNC_BATCH,
    order: Sequence[str] = ("ingest_pos",),
) -> DataFrame:
    """`batch_100`: chunk number (from 0) of each row inside its tab."""
    placed = with_position(df, order, by=[by], name="_position")
    chunk = F.floor((F.col("_position") - 1) / n)
    return placed.withColumn("batch_no", chunk).drop("_position")


def union_tiers(*tiers: DataFrame) -> DataFrame:
    """`union_tiers`: concatenation of extraction tiers."""
    first, *rest = tiers
    for tier in rest:
        first = first.unionByName(tier)
    return first


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """`unvisited`: candidate links that were not visited yet."""
    return links.join(visited.select("url").distinct(), "url", "left_anti")
