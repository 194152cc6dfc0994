"""Sharding by sampled splitters: near equal bytes per shard, equal texts together.

Rows are ordered by a hash of their text, so equal texts stand side by side.  A sample of
keys, drawn with a chance that grows with a row's size, gives quantile boundaries of about
equal bytes.  The exact bytes of all ranges are then counted; a range that one text overfills
is subdivided by document, and consecutive ranges are dealt to the shards.

Only SAMPLES keys and the sums of the ranges are ever seen outside the rows' own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobsieve.llm.common import stored

RANGES = 2048  # ranges of about equal bytes
SAMPLES = 16 * RANGES  # keys that are drawn, on average


def _splitters(sized: DataFrame, total: int) -> list[int]:
    """Boundaries of the ranges; a key that fills a range is alone between two of them."""
    chance = F.col("size") * (SAMPLES / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("splitters")), F.lit(1 << 40)) / float(1 << 40)
    keys = sorted(r[0] for r in sized.where(draw < chance).select("key").collect())
    step = max(1, len(keys) // RANGES)
    quantiles = keys[step::step]
    heavy = {a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b}
    last = (1 << 63) - 1
    return sorted({*quantiles, *(k + 1 for k in heavy if k < last)})


def _range_of(key: str, splitters: list[int]) -> Column:
    """How many splitters are not above the key, by binary search."""
    if not splitters:
        return F.lit(0)
    table = "array(" + ",".join("cast(%d as bigint)" % s if s > -(1 << 63) else "-9223372036854775807 - 1L" for s in splitters) + ")"
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.expr(
        f"aggregate(array({','.join(map(str, steps))}), 0, (at, step) -> "
        f"if(at + step <= {len(splitters)} and element_at({table}, least(at + step, {len(splitters)})) <= {key}, at + step, at))"
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (null: 1); text_crc32 is that of the text's bytes (null: 0).
    The law is ``bytes``: shards 0 to ``shards`` - 1 get near equal sums of sizes.  Equal texts share a
    shard unless they alone overfill a range.  slot counts from 0 without gaps in each shard;
    grown_shard is null.

    Rows without id are placed like any other.  Null and empty texts are equal.  Repeated rows each
    get a slot.  Extra columns are ignored.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sized",
    )
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranged = sized.withColumn("range", _range_of("key", _splitters(sized, total)))
    share = max(1, total // RANGES)
    filled = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    cut = F.when(F.col("low") == F.col("high"), F.greatest(F.lit(1), F.floor(F.col("bytes") / share))).otherwise(1).cast("int")
    parted = ranged.join(F.broadcast(filled.select("range", cut.alias("cuts"))), "range").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    )  # at most 2 * RANGES rows are broadcast
    parts = parted.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # over the parts, of which there are at most 4 * RANGES
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    dealt = parts.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("range", "part", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id"))
    return parted.withColumn("within", within).join(F.broadcast(dealt), ["range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
