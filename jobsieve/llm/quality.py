"""Quality of documents by an interpolated modified Kneser-Ney model of character trigrams.

Characters, not words: the model then covers any text after little training and shouting,
symbol noise and tables are as unlikely as they should be.

Each chunk of texts is turned once into counts of (trigram, document), packed by shards of the
trigram's middle character.  The counts of trusted documents are summed to the training counts;
a shard holds all that the probability of its trigrams needs (the trigrams, their contexts, the
continuations of the pair behind the middle character), except the unigram probabilities, which
the alphabet bounds.  Packed counts and model shards meet in a join on the shard, hot shards split,
and the partial sums of a document add up to its perplexity.  A document is kept if its perplexity is
not above a quantile of trusted documents of its language that the model has not seen.  The quantile
is the one that does best on the labels, where a trusted document that is lost costs as much as a
low-quality one that stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import identified, stored
from jobsieve.llm.wordhash import ragged

SHARDS = 16
WAY_CHUNKS = 128  # chunks whose counts of a shard meet one copy of the model's shard
CHUNK = 1 << 19  # characters that are counted together
ROWS = 256  # rows that are turned into Python strings together
QUANTILES = [round(0.9 + 0.005 * k, 3) for k in range(20)] + [0.999]  # of unseen trusted documents' perplexities, to choose from
QUANTILE = 0.95  # without low-quality documents to choose by
UNSEEN = 3  # one of so many trusted documents is kept from the model
LEAST_TRUSTED = 100  # unseen trusted documents that a language's own threshold needs
LEAST_POOR = 20  # low-quality documents that a language's own quantile needs
BEGIN, END = "\x02", "\x03"

_PAIR = (1 << 42) - 1
_LETTER = (1 << 21) - 1


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(data))


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack_counts(ids: np.ndarray, keys: np.ndarray, per: np.ndarray, number: np.ndarray, count: np.ndarray) -> bytes:
    """Counts of one shard of a chunk; the ascending keys as steps."""
    return _pack(ids, _small(np.diff(keys, prepend=0)), _small(per), _small(number), _small(count))


def _unpack_counts(data: bytes) -> tuple[np.ndarray, ...]:
    ids, steps, per, number, count = _unpack(data)
    return ids, np.cumsum(steps.astype(np.int64)), per.astype(np.int64), number.astype(np.int64), count.astype(np.int64)


def _shard_of(keys: np.ndarray) -> np.ndarray:
    middle = (keys >> 21) & _LETTER
    return (middle * 2654435761 >> 8) % SHARDS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)


def _segments(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Chunks of texts with their ids; long texts are cut, with the two characters before."""
    owners, parts, size = [], [], 0
    for doc, text in rows:
        for at in range(0, len(text), CHUNK):
            before = text[at - 2 : at] if at else 2 * BEGIN
            owners.append(doc)
            parts.append(before + text[at : at + CHUNK] + (END if at + CHUNK >= len(text) else ""))
            size += len(parts[-1])
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk and shard: packed (ids, trigrams, documents per trigram, document numbers, counts)."""
    task = TaskContext.get().partitionId() << 32  # chunks are unique, and the same when the task runs again
    for number_of_chunk, (owners, parts) in enumerate(_segments(_texts(batches))):
        letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        at = ragged(starts, sizes - 2)
        keys, code = np.unique(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2], return_inverse=True)
        pair, count = np.unique(code * len(parts) + np.repeat(np.arange(len(parts)), sizes - 2), return_counts=True)
        key_of, number = pair // len(parts), pair % len(parts)
        ids = np.array(owners, np.int64)
        shard, rows = _shard_of(keys), []
        for s in np.unique(shard).tolist():
            own = shard[key_of] == s
            mine = np.flatnonzero(shard == s)
            per = np.bincount(key_of[own], minlength=len(keys))[mine]
            rows.append((s, _pack_counts(ids, keys[mine], per, number[own], count[own])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([task + number_of_chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([owners if k == 0 else [] for k in range(len(rows))], pa.list_(pa.int64())),
            ],
            names=["chunk", "shard", "counts", "docs"],
        )


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): trigram counts of the trusted documents, added up within a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        keys, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.bincount(code, weights=np.concatenate([n for _, n in held])).astype(np.int64)
        held.clear()
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(total[a : a + 100_000])], names=["key", "n"])

    for batch in batches:
        for data, trusted in zip(batch.column("counts").to_pylist(), batch.column("trusted").to_pylist(), strict=True):
            ids, keys, per, number, count = _unpack_counts(data)
            good = np.isin(ids, np.array(trusted, np.int64))[number]
            total = np.bincount(np.repeat(np.arange(len(keys)), per)[good], weights=count[good], minlength=len(keys))
            seen = total > 0
            held.append((keys[seen], total[seen]))
            if sum(len(k) for k, _ in held) > 1_000_000:
                yield from flush()
    if held:
        yield from flush()


def _discounts(counts: DataFrame, column: str) -> list[float]:
    """The discounts of counts of 1, 2, and 3 or more, from the counts of counts."""
    found = {r[0]: r[1] for r in counts.where(F.col(column) <= 4).groupBy(column).count().collect()}
    n = [0, *(found.get(k, 0) for k in range(1, 5))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    result = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k
        result.append(min(max(d, 0.05 * k), 0.95 * k))
    return result


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _weights(group: np.ndarray, counts: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct groups, their totals, and the mass that discounting frees in each."""
    groups, code = np.unique(group, return_inverse=True)
    total = np.bincount(code, weights=counts)
    freed = np.bincount(code, weights=np.array(d)[np.minimum(counts, 3)])
    return groups, total, freed / total


def _model_shard(unigrams: tuple[np.ndarray, np.ndarray, float], d2: list[float], d3: list[float]):
    """All that scoring needs of one shard's trigrams, packed into a row."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy())
        keys, n = table.column("key").to_numpy()[order], table.column("n").to_numpy()[order]
        letters, singles, unseen = unigrams
        pairs, follows = np.unique(keys & _PAIR, return_counts=True)
        middles, m_total, m_freed = _weights(pairs >> 21, follows, d2)
        at = np.searchsorted(middles, pairs >> 21)
        p2 = (follows - np.array(d2)[np.minimum(follows, 3)]) / m_total[at] + m_freed[at] * _lookup(letters, singles, pairs & _LETTER, unseen)
        contexts, c_total, c_freed = _weights(keys >> 21, n, d3)
        at = np.searchsorted(contexts, keys >> 21)
        p3 = (n - np.array(d3)[np.minimum(n, 3)]) / c_total[at] + c_freed[at] * p2[np.searchsorted(pairs, keys & _PAIR)]
        packed = _pack(keys, p3, contexts, c_freed, pairs, p2, middles, m_freed)
        return pa.table({"shard": table.column("shard").slice(0, 1), "model": pa.array([packed], pa.binary())})

    return run


def _scored(unigrams: tuple[np.ndarray, np.ndarray, float]):
    """(doc_id, logp, n): what each shard adds to the documents of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, singles, unseen = unigrams
        empty = np.zeros(0, np.int64)
        for batch in batches:
            for data, model in zip(batch.column("counts").to_pylist(), batch.column("model").to_pylist(), strict=True):
                ids, keys, per, number, count = _unpack_counts(data)
                seen, p3, contexts, c_freed, pairs, p2, middles, m_freed = _unpack(model) if model else (empty,) * 8
                one = _lookup(letters, singles, keys & _LETTER, unseen)
                two = _lookup(pairs, p2, keys & _PAIR, -1.0)
                two = np.where(two < 0, _lookup(middles, m_freed, (keys >> 21) & _LETTER, 1.0) * one, two)
                three = _lookup(seen, p3, keys, -1.0)
                three = np.where(three < 0, _lookup(contexts, c_freed, keys >> 21, 1.0) * two, three)
                logs = np.repeat(np.log(three), per)
                total = np.bincount(number, weights=logs * count, minlength=len(ids))
                size = np.bincount(number, weights=count, minlength=len(ids)).astype(np.int64)
                own = size > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(total[own]), pa.array(size[own])], names=["doc_id", "logp", "n"])

    return run


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, n, perplexity) of the documents with text, under a model of those whose doc_id is in ``trusted``."""
    counts = stored(docs.where("text != ''").mapInArrow(_counts, "chunk long, shard int, counts binary, docs array<long>"), "counts")
    members = counts.select("chunk", F.explode("docs").alias("doc_id"))
    masks = members.join(trusted, "doc_id", "left_semi").groupBy("chunk").agg(F.collect_set("doc_id").alias("trusted"))  # ids of one chunk
    # both joins of the counts are shuffled at every size, so that the plan does not change with the input
    training = counts.select("chunk", "counts", "shard").join(masks.hint("merge"), "chunk").select("counts", "trusted").mapInArrow(_trained, "key long, n long")
    trigrams = stored(training.groupBy("key").agg(F.sum("n").alias("n")), "trigrams")
    pairs = stored(trigrams.groupBy(F.expr(f"key & {_PAIR}").alias("pair")).count(), "pairs")
    d2, d3 = _discounts(pairs, "count"), _discounts(trigrams, "n")
    letters = pairs.groupBy(F.expr(f"pair & {_LETTER}").alias("letter")).count().orderBy("letter").collect()  # the alphabet
    total, kinds = sum(r["count"] for r in letters), len(letters)
    unseen = 0.5 * kinds / max(total, 1) / (kinds + 1) if kinds else 1.0
    single = np.array([(r["count"] - 0.5) / total + unseen for r in letters], float)
    unigrams = (np.array([r["letter"] for r in letters], np.int64), single, unseen)

    shard = F.expr(f"cast(shiftright(((key >> 21) & {_LETTER}) * 2654435761, 8) % {SHARDS} as int)")
    model = trigrams.withColumn("shard", shard).groupBy("shard").applyInArrow(_model_shard(unigrams, d2, d3), "shard int, model binary")
    ways = max(1, -(-counts.select("chunk").distinct().count() // WAY_CHUNKS))
    every = F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    spread = counts.select("shard", F.pmod(F.xxhash64("chunk"), F.lit(ways)).cast("int").alias("way"), "counts")
    met = spread.join(model.select("shard", every.alias("way"), "model").hint("merge"), ["shard", "way"], "left")
    sums = met.select("counts", "model").mapInArrow(_scored(unigrams), "doc_id long, logp double, n long")
    return sums.groupBy("doc_id").agg(F.sum("n").alias("n"), F.exp(-F.sum("logp") / F.sum("n")).alias("perplexity"))


def unseen():
    """Trusted rows that the model does not learn from."""
    return F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(UNSEEN)) == 0


def _limits(rated: DataFrame, *by: str) -> DataFrame:
    """(by..., good, poor, limits, chosen): row counts, the thresholds at QUANTILES, and the best one's number."""
    percents = [k / 1000 for k in range(1, 1000)]
    value = F.col("perplexity")
    found = rated.groupBy(*by).agg(
        F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("poor"),
        F.percentile_approx(F.when(F.col("good"), value), QUANTILES, 10_000).alias("limits"),
        F.percentile_approx(F.when(~F.col("good"), value), percents, 10_000).alias("spread"),
    )
    kept = F.lit(QUANTILES)
    gone = F.transform("limits", lambda x: F.size(F.filter("spread", lambda y: y > x)) / len(percents))
    rank = F.zip_with(kept, gone, lambda k, g: F.round(k + g, 6))
    best = F.array_max(F.transform(rank, lambda x, i: F.struct(x.alias("sum"), i.alias("number"))))  # of equals the loosest
    return found.withColumn("chosen", F.when(F.col("poor") > 0, best["number"])).drop("spread")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n, perplexity, threshold, kept) for each id of ``docs``.

    Trusted are the documents whose label has quality 1; the model learns from all but every UNSEEN-th of
    them.  n counts scored characters, the end included.  threshold is a quantile of the unseen trusted
    documents' perplexities in the language, or of all of them if the language (null is one) has fewer than
    LEAST_TRUSTED; kept is perplexity <= threshold.  The quantile is the one of
    QUANTILES that maximises the share of unseen trusted documents kept plus the share of documents with
    quality 0 rejected, in the language, or in all if it has fewer than LEAST_POOR of these.  Without any of
    these it is QUANTILE.

    Rows without id are left out; rows that repeat an id are one document.  A null or empty text has no
    perplexity and is not kept.  Without trusted documents everything with text is kept; if none of them
    is unseen, the threshold is that of the seen ones.  An id with labels of both kinds is trusted.  Repeated or
    null labels are harmless.  Extra columns are ignored.  An empty table gives no rows.
    """
    texts = identified(docs)
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    trusted = known.where("good").where(~unseen()).select("doc_id")
    named = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("lang").cast("string")).alias("lang")
    )
    scored = stored(named.join(perplexities(texts, trusted), "doc_id", "left"), "perplexities")
    rated = scored.join(known, "doc_id").where("perplexity is not null")
    rated = stored(rated.select("doc_id", "lang", "perplexity", "good"), "rated")
    judges = rated.where(unseen() | ~F.col("good"))
    overall = _limits(judges).first()
    if not overall["good"]:
        overall = _limits(rated).first()
    number = overall["chosen"] if overall["chosen"] is not None else QUANTILES.index(QUANTILE)
    own = _limits(judges, "lang").where(F.col("good") >= LEAST_TRUSTED)
    limit = F.element_at("limits", F.when(F.col("poor") >= LEAST_POOR, F.col("chosen")).otherwise(F.lit(number)) + 1)
    any_language = overall["limits"][number] if overall["limits"] else None
    bound = own.select(F.col("lang").alias("of"), limit.alias("own"))
    limited = scored.join(bound, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(any_language).cast("double"), F.lit(float("inf")))
    return limited.select(
        "doc_id", "lang", "n", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"),
    )
