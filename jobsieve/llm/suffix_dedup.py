"""Removal of byte strings that documents with smaller ids already hold.

A suffix matters here by its first ``span`` bytes only.  The suffixes are put into
buckets by a cover sample, and the buckets are sorted one after the other:

* The cover sample takes, of every ``span`` bytes, the ``gram`` bytes with the smallest
  hash.  Equal strings are sampled at the same offset, which is what a difference cover
  guarantees; but samples follow the content, so 6 % of all places do instead of the 19 % of
  a positional cover (see README for the figures).
* Sample ranks are found first.  A rank that one document holds alone settles all
  suffixes of its bucket at once; only the others travel, as runs of bytes around a sample.
* Documents that equal one with a smaller id lose all their bytes and give away nothing new;
  they neither sample nor travel.
* Each bucket is sorted by the hashes of its suffixes and then by document, as a stream:
  of the bucket at hand only the distinct suffixes are kept, however many copies pass.
  Copies inside one batch of documents are settled before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import identified, stored
from jobsieve.llm.wordhash import ragged, rolling_hashes, text_bytes

GRAM = 16  # bytes of a sample
PIECE = 1 << 19  # places that are looked at together
FILTER_BITS = 1 << 26  # of a filter: 8 MB, whatever the input; a full filter only lets more rows travel
PACK = 4096  # a packed run is start * PACK + length
WHOLE = -1  # the run of a document that goes as a whole


def _runs(raw: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(sample hash, text number, first place in the batch, suffixes) of the runs of suffixes with one sample."""
    width = span - GRAM + 1
    for begin in range(0, max(0, len(raw) - span + 1), PIECE):
        part = raw[begin : begin + PIECE + span - 1]
        count = len(part) - span + 1
        text = np.searchsorted(offsets, np.arange(begin, begin + count), side="right") - 1
        valid = offsets[text + 1] - np.arange(begin, begin + count) >= span
        hashes = rolling_hashes(part, GRAM)
        value, place, done = hashes, np.arange(len(hashes), dtype=np.int32), 1
        while done < width:
            step = min(done, width - done)
            later = value[step:] < value[:-step]
            value = np.where(later, value[step:], value[:-step])
            place = np.where(later, place[step:], place[:-step])
            done += step
        new = valid.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last)
        yield hashes[place[starts]], text[starts], begin + starts, ends - starts + 1


def _filter(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds every value of the one column of ``keys``, and few others."""
    key = keys.columns[0]
    words = (
        keys.select(F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("half"))
        .select(F.pmod("half", F.lit(FILTER_BITS)).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    table = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def _held(bits: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Which samples the filter holds."""
    hit = np.ones(len(sample), bool)
    for shift in (0, 32):
        place = (sample >> np.uint64(shift)) % np.uint64(FILTER_BITS)
        hit &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _first_copies(batch: pa.RecordBatch, copies: np.ndarray) -> pa.RecordBatch:
    """The documents that may be the first with their text."""
    return batch.filter(pa.array(_held(copies, batch.column("key").to_numpy().view(np.uint64))))


def _samples(span: int, firsts: Broadcast):
    """One row for each sample of a batch, two for a sample of two or more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _first_copies(batch, firsts.value)
            ids = batch.column("doc_id").to_numpy()
            found = list(_runs(*text_bytes(batch.column("text")), span))
            if not found:
                continue
            sample = np.concatenate([x[0] for x in found])
            doc = ids[np.concatenate([x[1] for x in found])]
            order = np.argsort(sample)
            sample, doc = sample[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], sample[1:] != sample[:-1]))) if len(sample) else np.zeros(0, np.int64)
            if not len(first):
                continue
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            rows = np.concatenate((sample[first], sample[first][several])).view(np.int64)
            for a in range(0, len(rows), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + 200_000])], names=["sample"])

    return run


def _contexts(span: int, firsts: Broadcast, shared: Broadcast):
    """Runs of suffixes with a shared sample; those settled inside the batch carry no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            batch = _first_copies(batch, firsts.value)
            ids = batch.column("doc_id").to_numpy()
            raw, offsets = text_bytes(batch.column("text"))
            parts = []
            for sample, text, start, count in _runs(raw, offsets, span):
                hit = _held(bits, sample)
                parts.append((sample[hit], text[hit], start[hit], count[hit]))
            if not parts:
                continue
            sample, text, start, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
            doc = ids[text]
            for rows in _portions(sample, count):
                lengths = count[rows] + span - 1
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                data = raw[ragged(start[rows], lengths)]
                held = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                code = held.dictionary_encode().indices.to_numpy()
                least = np.full(int(code.max()) + 1 if len(code) else 0, np.iinfo(np.int64).max)
                np.minimum.at(least, code, doc[rows])
                settled = doc[rows] > least[code]
                spread = sample[rows].view(np.int64) + np.where(settled, doc[rows], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spread), pa.array(doc[rows]), pa.array((start[rows] - offsets[text[rows]]) * PACK + lengths),
                        pa.array(held.to_numpy(zero_copy_only=False), pa.binary(), mask=settled),
                    ],
                    names=["sample", "doc_id", "run", "bytes"],
                )

    return run


def _portions(sample: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in portions of about 3 MB of bytes, equal samples together."""
    order = np.argsort(sample, kind="stable")
    new = np.concatenate(([True], sample[order][1:] != sample[order][:-1])) if len(order) else np.zeros(0, bool)
    size = np.cumsum(count[order] + 64) // (3 << 20)
    group = np.maximum.accumulate(np.where(new, size, 0)) if len(order) else size
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []:
        yield part


def _sorted_buckets(span: int):
    """Removed places of runs that come ordered by sample and document, as packed runs per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, since = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            sample = batch.column("sample").to_numpy()
            doc = batch.column("doc_id").to_numpy()
            packed = batch.column("run").to_numpy()
            start, length = packed // PACK, packed % PACK
            bare = batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
            out_doc, out_run = [doc[bare]], [packed[bare]]
            open_rows = np.flatnonzero(~bare)
            if len(open_rows):
                raw, offsets = text_bytes(batch.column("bytes").take(pa.array(open_rows)).cast(pa.large_binary()))
                count = length[open_rows] - span + 1
                hashed = rolling_hashes(raw, span)[ragged(offsets[:-1], count)]
                row = np.repeat(open_rows, count)
                keep = 0
                if last is not None and sample[open_rows[0]] == last:
                    keep = len(seen)
                    hashed = np.concatenate((seen, hashed))
                owner = np.concatenate((since[:keep], doc[row]))
                order = np.argsort(hashed, kind="stable")  # rows come in document order, so each group's first is its least
                ranked = hashed[order]
                first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                sizes = np.diff(np.append(first, len(ranked)))
                least = np.empty(len(ranked), np.int64)
                least[order] = np.repeat(owner[order[first]], sizes)
                gone = (owner > least)[keep:]
                edge = np.concatenate(([True], row[1:] != row[:-1]))
                new, end = gone.copy(), gone.copy()
                new[1:] &= ~gone[:-1] | edge[1:]
                end[:-1] &= ~gone[1:] | edge[1:]
                new, end = np.flatnonzero(new), np.flatnonzero(end)
                begins = np.searchsorted(row, row[new])
                out_doc.append(doc[row[new]])
                out_run.append((start[row[new]] + new - begins) * PACK + end - new + span)
                last = sample[open_rows[-1]]
                own = np.concatenate((np.full(keep, last), sample[row]))[order[first]] == last
                seen, since = ranked[first][own], owner[order[first]][own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_run))], names=["doc_id", "run"]
            )

    return run


def _kept_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(removed bytes, maximal removed runs, remaining bytes) of each text of a batch with its packed runs."""
    raw, offsets = text_bytes(batch.column("text"))
    for k, packed in enumerate(batch.column("_repeated_runs").to_pylist()):
        text = raw[offsets[k] : offsets[k + 1]]
        if not packed:
            yield 0, 0, text.tobytes()
        elif WHOLE in packed:
            yield len(text), 1, b""
        else:
            pairs = np.array(packed, np.int64)
            edges = np.zeros(len(text) + 1, np.int64)
            np.add.at(edges, pairs // PACK, 1)
            np.add.at(edges, pairs // PACK + pairs % PACK, -1)
            gone = np.cumsum(edges[:-1]) > 0
            yield int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), text[~gone].tobytes()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(_kept_parts(batch))
        sizes = [removed + len(kept) for removed, _, kept in parts]
        columns = [pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([kept.decode("utf-8", "ignore") for _, _, kept in _kept_parts(batch)], pa.string())
        yield batch.drop_columns(["_repeated_runs"]).set_column(batch.schema.get_field_index("text"), "text", texts)


def _repeated_runs(docs: DataFrame, span: int) -> DataFrame:
    """(id, runs): the packed runs of bytes that go from each document."""
    if span > PACK // 2:
        raise ValueError(f"span is at most {PACK // 2}")
    context = docs.sparkSession.sparkContext
    docs = identified(docs).withColumn("key", F.xxhash64("doc_id"))
    digests = stored(docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    firsts = context.broadcast(_filter(first.select(F.xxhash64("first").alias("key"))))
    samples = docs.mapInArrow(_samples(span, firsts), "sample long").repartition("sample")
    shared = samples.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample")
    known = context.broadcast(_filter(shared))
    contexts = docs.mapInArrow(_contexts(span, firsts, known), "sample long, doc_id long, run long, bytes binary")
    found = (
        contexts.repartition("sample").sortWithinPartitions("sample", "doc_id")
        .mapInArrow(_sorted_buckets(span), "doc_id long, run long")
    )
    copies = digests.where(F.col("n_bytes") >= span).join(first, "digest").where("doc_id > first")
    runs = found.union(copies.select("doc_id", F.lit(WHOLE).cast("long").alias("run")))
    return runs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("run").alias("_repeated_runs"))  # bounded by the document's own length


def remove_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of ``docs`` that has an id.

    A byte goes if some ``span`` bytes that cover it also start in a document with a smaller id.
    Strings are judged on the input; matches never cross documents.  ``kept`` holds the remaining bytes.

    Rows without id are left out.  A null text is empty; texts shorter than ``span`` lose nothing and
    take nothing.  Rows that repeat an id are one document to each other, so none of them removes
    another's bytes.  Extra columns are ignored.  An empty table gives no rows.
    """
    runs = _repeated_runs(docs, span)
    rows = identified(docs)
    joined = rows.join(runs, rows["doc_id"] == runs["id"], "left").select("doc_id", "text", "_repeated_runs")
    return joined.mapInArrow(_measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def shorten_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs`` with every text cut as by ``remove_repeats``; a character cut in two goes as a whole.

    All rows and columns stay; n_chars, if there is one, is counted anew.  Rows without id keep their text.
    """
    runs = _repeated_runs(docs, span).withColumnRenamed("id", "_repeated_id")
    joined = docs.join(runs, docs["doc_id"] == F.col("_repeated_id"), "left").drop("_repeated_id")
    cut = joined.mapInArrow(_shortened, docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut
