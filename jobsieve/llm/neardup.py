"""Near-duplicate documents by bottom-k sketches, confirmed by exact Jaccard similarity.

One hash function orders all shingles.  A document's sketch holds its SKETCH smallest
shingle hashes (all of them, if it has no more).  Inverted lists of the retained values
show which sets overlap.

Which lists a set must look into follows from the union sketch: of the smallest values of
the union of two linked sets at least a known number is common to both.  That number is
exact for sets kept whole whose partners are all kept whole too, and else at most the
hypergeometric mean less six deviations, for the largest partner that a set can be linked
with (missed with a chance below one in a million per pair).  If at least c of k retained values are
shared, then two sets meet in one of their k - c + 1 rarest values, so each set looks into
its rarest lists only and a passage that a third of all documents carry is not even opened.

Sets that meet in a list are gathered under the list's smallest set.  Inside such a group
the exact intersections of whole sets are counted in blocks, and only a spanning star of
the confirmed links leaves a task, so that a group of thousands of near copies does not
turn into millions of rows.  Equal sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import components, identified, stored
from jobsieve.llm.wordhash import shingle_sets

SKETCH = 128  # retained values of a set
BLOCK = 1024  # members of a group that one task compares with as many others

_SET_FIELDS = "doc_id long, text_id long, n_shingles long, set_id long"


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_counts(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id): the size of each text's shingle set and a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [], []
            for own in shingle_sets(batch.column("text"), words):
                sizes.append(len(own))
                ids.append(_set_id(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())],
                names=["doc_id", "text_id", "n_shingles", "set_id"],
            )

    return docs.mapInArrow(run, _SET_FIELDS)


def _retained(docs: DataFrame, words: int) -> DataFrame:
    """(value, set_id, n): the retained values of each distinct set of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            values, ids, sizes = [], [], []
            for own in shingle_sets(batch.column("text"), words):
                key = _set_id(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    values.append(own[:SKETCH])
                    ids.append(key)
                    sizes.append(len(own))
            kept = [len(v) for v in values]
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            for a in range(0, len(flat), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat[part].view(np.int64)),
                        pa.array(np.repeat(np.array(ids, np.int64), kept)[part]),
                        pa.array(np.repeat(np.array(sizes, np.int64), kept)[part]),
                    ],
                    names=["value", "set_id", "n"],
                )

    return docs.mapInArrow(run, "value long, set_id long, n long")


def _looked_into(threshold: int):
    """How many of its rarest retained values a set of n must look into."""
    t = threshold / 100
    k = F.least(F.col("n"), F.lit(SKETCH)).cast("double")
    union = F.floor(F.col("n") * 100 / threshold)  # the largest union of two linked sets, and the largest partner
    odds = max(t, 0.5) * (1 - max(t, 0.5))  # at its greatest for shares of t or more
    spread = F.sqrt(SKETCH * odds * (union - SKETCH) / F.greatest(union - 1, F.lit(1)))
    whole = F.ceil(F.col("n") * threshold / 100)
    drawn = F.floor(SKETCH * t - 6 * spread)  # SKETCH values drawn of a set, or of a union, of which t or more are common
    common = F.when(union <= SKETCH, whole).otherwise(F.least(whole, drawn))
    return (k - common + 1).cast("int")


def _groups(retained: DataFrame, threshold: int) -> DataFrame:
    """(leader, set_id) of all sets that meet in an inverted list, the leader included."""
    counted = (
        retained.repartition("value").dropDuplicates(["value", "set_id"])
        .selectExpr("value", "set_id", "n", "count(1) over (partition by value) as lists")
        .where("lists > 1")
    )
    rarest = F.sort_array(F.collect_list(F.struct("lists", "value")))  # at most SKETCH entries
    opened = (
        counted.groupBy("set_id", "n").agg(rarest.alias("held"))
        .withColumn("room", _looked_into(threshold) - (F.least(F.col("n"), F.lit(SKETCH)) - F.size("held")))
        .where("room > 0")
        .select("set_id", F.explode(F.slice("held", F.lit(1), F.col("room").cast("int"))).alias("h"))
        .select("set_id", F.col("h.value").alias("value"))
    )
    met = opened.selectExpr("set_id", "min(set_id) over (partition by value) as leader")
    pairs = met.where("set_id != leader").distinct()
    return pairs.union(pairs.select(F.col("leader").alias("set_id"), "leader").distinct()).select("leader", "set_id")


def _confirmed(words: int, threshold: int):
    """Exact links inside one block pair of a group, as a star around each local component."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_numpy()
        blocks = table.column("block").to_numpy()
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.lexsort((ids, blocks))
        texts = table.column("text").combine_chunks().take(pa.array(order))
        ids, blocks = ids[order], blocks[order]
        sets = list(shingle_sets(texts, words))
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        by_code = np.argsort(code, kind="stable")
        begins = np.searchsorted(code[by_code], np.arange(code.max() + 2))
        posting = owner[by_code]
        parent = np.arange(len(sets))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ends = np.cumsum(sizes)
        for x in range(len(sets)):
            own = code[ends[x] - sizes[x] : ends[x]]
            starts, lengths = begins[own], begins[own + 1] - begins[own]
            shift = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
            common = np.bincount(posting[np.arange(lengths.sum()) + shift], minlength=len(sets))
            linked = 100 * common >= threshold * (sizes + sizes[x] - common)
            linked[: x + 1] = False
            if first != second:
                linked &= blocks != blocks[x]
            for y in np.flatnonzero(linked).tolist():
                a, b = top(x), top(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        tops = np.array([top(x) for x in range(len(sets))])
        held = tops != np.arange(len(sets))
        return pa.table({"a": pa.array(ids[held], pa.int64()), "b": pa.array(ids[tops[held]], pa.int64())})

    return run


def _with_text_id(docs: DataFrame) -> DataFrame:
    """Tells the texts of rows that repeat an id apart."""
    return docs.withColumn("text_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _placed(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(doc_id, text_id, n_shingles, least) of identified rows: least is the first (doc_id, text_id) reachable, null without words."""
    docs = _with_text_id(docs)
    sets = stored(shingle_counts(docs, words), "sets")
    filled = sets.where("n_shingles > 0")
    classes = stored(filled.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_id")).alias("rep")), "classes")
    groups = stored(_groups(_retained(docs, words), threshold), "groups")
    sized = (
        groups.join(groups.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "leader")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    )
    needed = groups.select("set_id").distinct().join(classes, "set_id").select("set_id", "rep.doc_id", "rep.text_id")
    texts = docs.join(needed, ["doc_id", "text_id"]).dropDuplicates(["set_id"]).select("set_id", "text")  # rows alike in id and text
    links = (
        sized.join(texts, "set_id")
        .groupBy("leader", "i", "j")
        .applyInArrow(_confirmed(words, threshold), "a long, b long")
    )
    roots = components(links)
    least = (
        roots.join(classes, roots["node"] == classes["set_id"])
        .groupBy("root").agg(F.min("rep").alias("first"))
    )
    placed = roots.join(least, "root").select(F.col("node").alias("set_id"), "first")
    named = classes.join(placed, "set_id", "left").select("set_id", F.coalesce("first", "rep").alias("least"))
    return sets.join(named, "set_id", "left").select("doc_id", "text_id", "n_shingles", "least")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` that has an id.

    Words are runs of bytes that are not ASCII white space, A-Z lower-cased; a set holds the distinct
    shingles of ``words`` words, or the whole sequence of a shorter text.  Two texts are linked when
    100 * intersection >= ``threshold`` * union.  component_id is the smallest id reachable by links;
    kept is true where it is the row's own.

    Rows without id are left out, as nothing could point at them.  A null or empty text, or one
    without words, has n_shingles 0, is linked with nothing and kept.  Rows that repeat an id appear as
    often as given, each with the links of its own text; equal texts are linked.  Extra columns are ignored.
    An empty table gives no rows.
    """
    placed = _placed(identified(docs), words, threshold)
    component = F.coalesce("least.doc_id", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id stays, and one of rows alike.

    Rows that repeat an id with another text are documents of their own.  Rows without id, and texts without words, stay.
    """
    placed = stored(_placed(identified(docs), words, threshold), "placed").where("least is not null")
    gone = placed.where("doc_id != least.doc_id or text_id != least.text_id").select("doc_id", "text_id").distinct()
    kept = _with_text_id(docs).join(gone, ["doc_id", "text_id"], "left_anti")
    again = placed.groupBy("doc_id", "text_id").count().where("count > 1").select("doc_id", "text_id")
    if not again.isEmpty():  # rows alike in id and text: one of them
        same = kept.join(again, ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"])
        kept = kept.join(again, ["doc_id", "text_id"], "left_anti").unionByName(same)
    return kept.select(*docs.columns)
