"""Language of documents by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 1 to 4 letters of its lower-cased words, ends of words marked.  Each is
hashed to a row of an embedding matrix; the average of the rows goes through a linear layer and a softmax.
Embeddings and layer are trained by stochastic gradient descent on a bounded sample of labelled rows.

Since everything before the softmax is linear, scoring needs only the product of both matrices, one small
row of numbers per hash.  A text's evidence is the sum of its subwords' rows, so texts of any length are
scored piece by piece and whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from jobsieve.llm.common import identified

BUCKETS = 1 << 16  # rows of the embedding matrix
SPAN = 4  # letters of the longest subword
WIDTH = 16  # components of an embedding
TRAIN_ROWS = 2000  # expected number of labelled rows that the model is fitted on, dealt evenly over the languages
WINDOWS = (24, 120)  # characters of the excerpts that are learnt besides each whole text
EPOCHS = 8
RATE = 0.5
SURE = 0.99  # share of right answers among accepted ones, on rows kept from training
PIECE = 1 << 20  # characters that are looked at together

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_KEEP = np.uint64(64 - BUCKETS.bit_length() + 1)


class Model(NamedTuple):
    languages: list[str]
    rows: np.ndarray  # BUCKETS x languages
    bias: np.ndarray  # the log shares of the languages included
    heat: float  # what evidence is multiplied with, so that scores are probabilities
    least: float  # score from which an answer is accepted


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower case of each code point that is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(text numbers, parts): long texts are cut after PIECE characters, with the rest of a subword that begins there."""
    owners, parts, size = [], [], 0
    for number, text in enumerate(texts):
        padded = f"\0{text}\0"
        for at in range(0, len(padded), PIECE):
            parts.append(padded[at : at + PIECE + SPAN - 1])
            owners.append(number)
            size += len(parts[-1])
            if size >= PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def subwords(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part number, bucket) of the subwords of each length that begin in the first PIECE characters of a part."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    inside = letter > 0
    sizes = np.array([len(p) for p in parts], np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    begins = np.ones(len(codes), bool)
    for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
        if size > PIECE:
            begins[end - size + PIECE : end] = False  # these begin the next part
    rolled = letter.astype(np.uint64) + np.uint64(1)
    hashed, inner = rolled, None
    for n in range(1, SPAN + 1):
        count = max(0, len(codes) - n + 1)
        if n > 1:
            hashed = hashed[:count] * _STEP + rolled[n - 1 :]
        if n > 2:
            inner = inside[1 : count + 1] if inner is None else inner[:count] & inside[n - 2 : n - 2 + count]
        good = begins[:count] & (inside[:count] if n == 1 else inside[:count] | inside[1 : count + 1] if n == 2 else inner)
        at = np.flatnonzero(good)
        mixed = (hashed[at] ^ (hashed[at] >> np.uint64(29))) * (_ODD + np.uint64(2 * n))
        yield part[at], (mixed >> _KEEP).astype(np.int64)


def _evidence(texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the subwords' rows of each text, and the numbers of subwords."""
    total, count = np.zeros((len(texts), rows.shape[1])), np.zeros(len(texts), np.int64)
    for owners, parts in _pieces(texts):
        owner = np.array(owners)
        for part, bucket in subwords(parts):
            if len(part):
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                np.add.at(total, owner[part[starts]], np.add.reduceat(rows[bucket], starts, axis=0, dtype=np.float64))
                np.add.at(count, owner[part[starts]], np.diff(starts, append=len(part)))
    return total, count


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    found = [bucket for _, parts in _pieces([text]) for _, bucket in subwords(parts)]
    return np.unique(np.concatenate(found), return_counts=True)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, bags): the packed bags of each text and of excerpts from it."""
    for batch in batches:
        rows = []
        for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True):
            cuts = [place % max(1, len(text) - w) for w in WINDOWS]
            bags = [_bag(t) for t in (text, *(text[a : a + w] for a, w in zip(cuts, WINDOWS, strict=True)))]
            packed = [(b.astype(np.uint16), n.astype(np.uint32)) for b, n in bags if len(b)]
            if packed:
                rows.append((lang, place, zstandard.compress(pickle.dumps(packed, protocol=5), 3)))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "place", "bags"])


def _chances(evidence: np.ndarray, bias: np.ndarray, heat: float) -> np.ndarray:
    z = heat * evidence + bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _descend(bags: list, target: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times layer, and the layer's bias, after EPOCHS passes over the bags in random order."""
    rng = np.random.default_rng(11)
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, kinds)), np.zeros(kinds)
    step, steps = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            bucket, share = bags[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ embedding[bucket]
            z = mean @ layer + bias
            z = np.exp(z - z.max())
            wrong = z / z.sum()
            wrong[target[k]] -= 1
            back = layer @ wrong
            layer -= rate * np.outer(mean, wrong)
            bias -= rate * wrong
            embedding[bucket] -= rate * len(bucket) ** 0.5 * share[:, None] * back
    return embedding @ layer, bias


def _fit(examples: pa.Table, shares: dict[str, float]) -> Model:
    """The model of the sampled rows; a fifth of them is kept from training to set heat and least score."""
    rows = sorted(zip(*(examples.column(c).to_pylist() for c in ("place", "lang", "bags")), strict=True))
    languages = sorted({lang for _, lang, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    bags, target, kept = [], [], []
    for number, (_, lang, data) in enumerate(rows):
        for bucket, count in pickle.loads(zstandard.decompress(data)):
            bags.append((bucket.astype(np.int64), count / count.sum()))
            target.append(languages.index(lang))
            kept.append(number % 5 == 4)
    target, kept = np.array(target), np.array(kept)
    rows_, bias = _descend([b for b, k in zip(bags, kept, strict=True) if not k], target[~kept], len(languages))
    share = np.array([shares[lang] for lang in languages])
    bias = bias + np.log(share * len(languages))
    judged = np.flatnonzero(kept) if kept.any() else np.arange(len(bags))
    evidence = np.stack([bags[k][1] @ rows_[bags[k][0]] for k in judged])
    weight = (share / np.bincount(target[judged], minlength=len(languages)).clip(1))[target[judged]]
    own = np.arange(len(judged)), target[judged]
    heats = np.geomspace(0.1, 10, 41)
    loss = [-(weight * np.log(_chances(evidence, bias, h)[own] + 1e-12)).sum() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    chance = _chances(evidence, bias, heat)
    best, right = chance.max(axis=1), chance.argmax(axis=1) == target[judged]
    order = np.argsort(-best, kind="stable")
    good = np.cumsum((weight * right)[order]) / np.cumsum(weight[order])
    enough = np.flatnonzero(good >= SURE)
    least = float(best[order][enough[-1]]) if len(enough) else 1.0
    return Model(languages, rows_.astype(np.float32), bias, heat, least)


def train(labelled: DataFrame) -> Model:
    """The model of ``labelled`` (doc_id, lang, text), fitted on about TRAIN_ROWS of its rows, drawn by a hash."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = {r["lang"]: r["n"] for r in counts.collect()}  # one row per language
    total, quota = sum(found.values()), TRAIN_ROWS / max(1, len(found))
    placed = labelled.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    sizes = labelled.sparkSession.createDataFrame(list(found.items()), "lang string, n long")  # as many rows as the driver holds
    drawn = placed.join(F.broadcast(sizes), "lang").where(F.col("place") / (1 << 40) * F.col("n") < quota)
    examples = drawn.select("lang", "place", "text").mapInArrow(_examples, "lang string, place long, bags binary").toArrow()
    return _fit(examples, {lang: n / total for lang, n in found.items()})


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 of 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row of ``docs`` with an id.

    Learnt are the rows with a language that are not held out, about TRAIN_ROWS of them, equally many per
    language as far as there are.  score is the probability of lang_pred, of equals the first in order;
    accepted is whether it reaches the score from which SURE of the answers on rows kept from training are
    right, and is false where it does not: the answer is then to be rejected.  A text that is null or has no letter, and any text
    if nothing could be learnt, is ``und`` with score 0 and not accepted.

    Rows without id are left out; repeated rows are returned as often as they occur, and equal texts get
    equal answers.  Extra columns are ignored.  An empty table gives no rows.
    """
    texts = identified(docs)
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null and lang is not null and text is not null")
    model = train(known.where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for begin in range(0, len(column), 256):
                part = column[begin : begin + 256].to_pylist()
                evidence, count = _evidence(part, model.rows)
                seen = count > 0
                pick, score = np.full(len(part), len(names) - 1), np.zeros(len(part))
                if len(model.languages) and seen.any():
                    chance = _chances(evidence[seen] / count[seen, None], model.bias, model.heat)
                    pick[seen], score[seen] = chance.argmax(axis=1), chance.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids[begin : begin + 256], pa.array(names[pick], pa.string()), pa.array(score), pa.array((pick < len(names) - 1) & (score >= model.least))],
                    names=["doc_id", "lang_pred", "score", "accepted"],
                )

    found = texts.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
