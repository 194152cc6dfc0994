"""Which patterns occur in which texts, for any number of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve.operators.spread import many_join, measured
from jobsieve.session import ready_for_checkpoint

_GRAMS = (1, 2, 3, 8)  # bytes by which patterns are looked up: the most that a pattern has


def _pieces(df: DataFrame, column: str, length: Column) -> DataFrame:
    """One row per place _at of a text, with the piece of ``length`` bytes that starts there and a hash of it as _key.

    Only the places are generated; the pieces are cut from the text's bytes by compiled code.
    """
    cut = df.withColumn("_bytes", F.col(column).cast("binary")).withColumn("_length", length)
    last = F.octet_length(column) - F.col("_length") + 1
    placed = cut.filter(last >= 1).withColumn("_at", F.explode(F.sequence(F.lit(1), last)))
    piece = placed.select(*df.columns, "_at", F.substring("_bytes", F.col("_at"), F.col("_length")).alias("_piece"))
    return piece.withColumn("_key", F.xxhash64("_piece"))


def substring_join(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each row of ``texts`` (distinct in text) with each row of ``patterns`` (distinct in pattern) that occurs in it.

    Each pattern is looked up by its rarest piece of eight bytes (shorter ones by three, two or one), an equi-join on
    a hash, and then checked in full.  Texts are kept, as they are read twice, and cut into the lengths that patterns
    are looked up by.  Their pieces meet the patterns' where the text is read, as long as the counted size of those
    allows a broadcast: only counts per piece and candidates are shuffled.  Beyond that a piece is split over
    sub-groups, so one that half of the texts hold spreads.  Empty patterns and null texts are in no result.
    """
    named = [c for c in patterns.columns if c != "pattern"]
    looked_up = F.coalesce(*[F.when(F.octet_length("pattern") >= k, F.lit(k)) for k in reversed(_GRAMS)])
    pattern_pieces = _pieces(patterns.filter(F.col("pattern") != ""), "pattern", looked_up).drop("_at").dropDuplicates(["pattern", "_piece"])
    wanted, small = measured(pattern_pieces.select("_key", F.octet_length("_piece").alias("_n")).distinct())
    lengths = sorted(r[0] for r in wanted.select("_n").distinct().collect())  # some of _GRAMS
    if not lengths:
        return texts.join(patterns.select("pattern", *named), F.lit(False))
    ready_for_checkpoint(texts.sparkSession)
    kept = texts.checkpoint()
    text_pieces = _pieces(kept.withColumn("_cut", F.explode(F.lit(lengths))), "text", F.col("_cut")).drop("_cut", "_piece")
    held = text_pieces.select("_key").join(F.broadcast(wanted) if small else wanted, "_key", "left_semi")
    frequency = held.groupBy("_key").count()
    rarest, small = measured(
        pattern_pieces.join(frequency, "_key")
        .groupBy("pattern", *named)
        .agg(F.min_by(F.struct(F.col("_piece").cast("string").alias("_piece"), "_key"), F.struct("count", "_key")).alias("_rarest"))
        .select("pattern", *named, "_rarest.*")
    )
    if not small:
        # the hashes alone may still fit: then only candidates are shuffled
        chosen, few = measured(rarest.select("_key").distinct())
        text_pieces = text_pieces.join(F.broadcast(chosen), "_key", "left_semi").select(text_pieces.columns) if few else text_pieces
    met = many_join(text_pieces, rarest, "_key", small).filter(F.contains("text", F.col("pattern")))
    # a text that repeats the piece meets the pattern once, at the first place
    first = F.octet_length(F.call_function("substring_index", F.col("text"), F.col("_piece"), F.lit(1))) + 1
    return met.filter(first == F.col("_at")).drop("_piece", "_key", "_at")
