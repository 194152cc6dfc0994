"""Shared building blocks that keep hot keys spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jobsieve.session import ready_for_checkpoint

LOOKUP_WAYS = 16  # sub-groups per key when a lookup table is too large to broadcast


def fits_broadcast(df: DataFrame) -> bool:
    """True when Catalyst's size estimate is within the session's broadcast limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 < size <= broadcast_limit(df.sparkSession)


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast limit in bytes; negative when broadcasts are off."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(limit[:-1]) * scale[limit[-1]] if limit[-1:] in scale else int(limit)


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` checkpointed, and whether its counted bytes are within the broadcast limit."""
    ready_for_checkpoint(df.sparkSession)
    kept = df.checkpoint()
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) + 8 if t == "string" else F.lit(16) for c, t in df.dtypes])
    size = kept.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return kept, size <= broadcast_limit(df.sparkSession)


def many_join(facts: DataFrame, rules: DataFrame, on: str, small: bool) -> DataFrame:
    """Inner join of facts with any number of rules per key.

    ``small`` rules are broadcast (see `measured`).  Else each key is split into LOOKUP_WAYS sub-groups by a
    hash of the fact row's position (or of the whole row), so a hot key spreads.
    """
    if small:
        return facts.join(F.broadcast(rules), on)
    salted = facts.withColumn("_way", F.pmod(F.xxhash64(*_identity(facts)), F.lit(LOOKUP_WAYS)))
    ways = F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_WAYS - 1).cast("long"))
    return salted.join(rules.withColumn("_way", F.explode(ways)), [on, "_way"]).drop("_way")


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join facts to a lookup table that has at most one row per key.

    The lookup side is broadcast only when its estimated size is within the
    broadcast limit.  Otherwise both sides are shuffled by the key: each row once,
    and only with the columns that are used.  Facts with a null key match nothing
    and are spread by a hash of their position; a key that holds a large share of
    the facts is split where Spark reads the shuffle (spark.sql.adaptive.skewJoin).
    """
    on = list(on)
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), on, how)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    way = F.when(missing, F.xxhash64(*_identity(facts))).otherwise(F.xxhash64(*on))
    return facts.withColumn("_way", way).join(lookup.withColumn("_way", F.xxhash64(*on)), [*on, "_way"], how).drop("_way")


def _identity(facts: DataFrame) -> list[str]:
    """What tells rows apart: their position, else all columns that can be hashed."""
    if "ingest_pos" in facts.columns:
        return ["ingest_pos"]
    return [c for c, t in facts.dtypes if not t.startswith(("map", "variant"))]


def salted_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """`lookup_join` for lookups that are small beside the facts.

    Each key is split into LOOKUP_WAYS sub-groups by a hash of the whole fact row, so a key that holds a third
    of the facts spreads without adaptive execution; the lookup rows are repeated once per sub-group.
    """
    on = list(on)
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), on, how)
    hashable = [c for c, t in facts.dtypes if not t.startswith(("map", "variant"))]
    salted = facts.withColumn("_way", F.pmod(F.xxhash64(*hashable), F.lit(LOOKUP_WAYS)))
    ways = F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_WAYS - 1).cast("long"))
    repeated = lookup.withColumn("_way", F.explode(ways))
    return salted.join(repeated, [*on, "_way"], how).drop("_way")


def first_by(df: DataFrame, keys: Sequence[str], order: str = "ingest_pos") -> DataFrame:
    """The row with the smallest order value per key, in one shuffle.

    min_by is combined on the map side, so a key with many copies sends one row
    per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 1-based position of each row inside its group, for groups of any size.

    A row_number() window would sort a whole group in one task.  Here the rows
    are range-partitioned by (group, order), numbered inside each partition, and
    shifted by the row counts of the partitions before; only those counts, one
    row per partition and group, pass through a window.  The numbered rows are
    checkpointed with all their columns because both uses must see the same
    partitioning, and the shifts are broadcast while they fit, so that the rows
    are shuffled once.  ``order`` must identify rows uniquely.
    """
    by = list(by)
    ready_for_checkpoint(df.sparkSession)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    numbered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row_id", 33))
        .checkpoint()
    )
    counts = numbered.groupBy("_part", *by).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row_id").alias("_first")
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    # about (partitions + groups) rows; Spark can't tell that, and would shuffle the rows beside them
    shifts, small = measured(shifts)
    placed = numbered.join(F.broadcast(shifts) if small else shifts, match)
    return placed.select(*df.columns, (F.col("_row_id") + F.col("_shift")).alias(name))
