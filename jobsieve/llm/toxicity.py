"""Toxic documents by a support vector machine on a gap-weighted subsequence string kernel.

The kernel of two strings adds up their common subsequences of ORDER letters, each worth
DECAY to the length it spans in either string, so "id-xiot" still resembles "idiot".  A text is
compared with a few landmark strings (Nyström): for each landmark a string has the share of the
landmark's own kernel that it reaches, cubed; a text has the greatest and the sum over the strings of
its sentences, whitened by the kernel matrix of the landmarks.  Landmarks are words, or stems of words, so inflected insults count too.  A linear machine with squared hinge loss is trained on these features,
and a rising curve turns its margin into a score.

Strings are the letters of white-space separated tokens; three or more single letters in a row
are joined first, so that spaced-out words count too.  Equal strings are compared once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import stored

ORDER = 3  # letters of a subsequence
DECAY = 0.6
STEM = range(4, 9)  # letters of the stems that may become landmarks
WIDTH = 24  # letters of a string at most; longer ones are cut into halves that overlap
TOXIC_ROWS = 4_000  # labelled rows the machine is fitted on, at most
CLEAN_ROWS = 8_000
TOXIC_LANDMARKS = 24
PLAIN_LANDMARKS = 8
TELLING = 2.0  # log odds of a landmark at least; common words differ by the lengths of texts
LEAST = 0.1  # feature values below are zero
KNOWN_STRINGS = 500_000  # strings whose features a worker remembers
SLICE = 4 << 20  # bytes of text that are looked at together

_KNOWN: dict[bytes, dict[str, np.ndarray | None]] = {}


def _codes(strings: list[str]) -> np.ndarray:
    """One row of character codes for each string, 0 where it has ended."""
    width = max(map(len, strings))
    joined = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(strings), width)


def subsequence_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of each row of ``left`` with the same row, or the only row, of ``right``."""
    left, right = left.T, right.T
    rows, m = left.shape[1], right.shape[0]
    square = np.float32(DECAY * DECAY)
    total = np.zeros(rows, np.float32)
    inner = np.zeros((ORDER, m + 1, rows), np.float32)
    inner[0] = 1
    for letter in left:
        same = ((letter == right) & (letter != 0)).astype(np.float32) * square
        total += np.einsum("jr,jr->r", same, inner[ORDER - 1, :m])
        for q in range(ORDER - 1, 0, -1):
            run = np.zeros(rows, np.float32)
            for j in range(m):
                run = DECAY * run + same[j] * inner[q - 1, j]
                inner[q, j + 1] = DECAY * inner[q, j + 1] + run
    return total


def similarities(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """How much of each landmark's own kernel (columns) a string (row) reaches, to the third power."""
    result = np.zeros((len(strings), len(landmarks)), np.float32)
    marks = [_codes([x]) for x in landmarks]
    own = [subsequence_kernel(x, x)[0] for x in marks]
    order = np.argsort([len(s) for s in strings], kind="stable")
    for part in np.array_split(order, max(1, len(order) // 4_096)) if strings else []:
        code = _codes([strings[i] for i in part])
        for k, mark in enumerate(marks):
            result[part, k] = np.minimum(1, subsequence_kernel(code, mark) / own[k]) ** 3
    result[result < LEAST] = 0
    return result


def _pieces(string: str) -> list[str]:
    if len(string) <= WIDTH:
        return [string]
    half = WIDTH // 2
    return [string[a : a + WIDTH] for a in range(0, len(string) - half, half)]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Text number and string number of every token of a slice, and the distinct strings' letters."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = words.flatten().dictionary_encode()
    letters = pc.replace_substring_regex(coded.dictionary, r"\PL+", "")
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    code, strings = coded.indices.to_numpy(), letters.to_pylist()
    single = np.array([len(s) == 1 for s in strings], bool)[code] if len(code) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    extra_owner, extra_code = [], []
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        for text in np.unique(owner[begin:end]).tolist() if end - begin > 2 else []:
            own = code[begin:end][owner[begin:end] == text]
            if len(own) > 2:
                extra_owner.append(text)
                extra_code.append(len(strings))
                strings.append("".join(strings[c] for c in own))
    if extra_owner:
        owner, code = np.concatenate((owner, extra_owner)), np.concatenate((code, extra_code))
    return owner, strings, code


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    for end in (np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist() + [len(texts)]:
        if end > begin:
            yield texts[begin:end]
        begin = end


def text_features(texts: pa.Array, landmarks: list[str]) -> np.ndarray:
    """For each landmark a text's greatest similarity, the logarithm of their sum, and their sum for its length."""
    known = _KNOWN.setdefault("\0".join(landmarks).encode(), {})
    parts = [np.zeros((0, 3 * len(landmarks)), np.float32)]
    for part in _slices(texts.fill_null("")):
        owner, strings, code = _tokens(part)
        if len(known) > KNOWN_STRINGS:
            known.clear()
        missing = [s for s in dict.fromkeys(strings) if s not in known]
        pieces = [(s, p) for s in missing for p in _pieces(s) if len(s) >= ORDER]
        known.update(dict.fromkeys(missing))
        for (string, _), values in zip(pieces, similarities([p for _, p in pieces], landmarks), strict=True):
            if values.any():
                before = known[string]
                known[string] = values if before is None else np.maximum(before, values)
        active = np.array([known[s] is not None for s in strings], bool)
        most, total = np.zeros((2, len(part), len(landmarks)), np.float32)
        hits = np.flatnonzero(active[code]) if len(code) else []
        if len(hits):
            values = np.stack([known[strings[c]] for c in code[hits]])
            np.maximum.at(most, owner[hits], values)
            np.add.at(total, owner[hits], values)
        length = np.bincount(owner, minlength=len(part))[:, None]
        parts.append(np.hstack((most, np.log1p(total), 10 * total / (100 + length))))
    return np.concatenate(parts)


def _string_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(string, toxic, clean): in how many texts of each label a string stands."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        counts: dict[str, list[int]] = {}
        begin = 0
        for part in _slices(batch.column("text").fill_null("")):
            owner, strings, code = _tokens(part)
            held = set(zip(owner.tolist(), (strings[c] for c in code), strict=True))
            held |= {(text, string[:k]) for text, string in held for k in STEM if k < len(string)}
            for text, string in held:
                if ORDER < len(string) <= WIDTH:
                    counts.setdefault(string, [0, 0])[0 if toxic[begin + text] else 1] += 1
            begin += len(part)
        rows = [(s, a, b) for s, (a, b) in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["string", "toxic", "clean"],
        )


def _landmarks(train: DataFrame) -> list[str]:
    """Strings that tell toxic texts best by the z-score of their log odds, and the most common plain ones."""
    sums = train.groupBy("toxic").count().collect()
    size = {bool(r["toxic"]): r["count"] for r in sums}
    counts = train.mapInArrow(_string_counts, "string string, toxic long, clean long").groupBy("string").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("c")
    )
    a, c = F.col("a") + 0.5, F.col("c") + 0.5
    odds = F.log(a / (size.get(True, 0) + 1 - a)) - F.log(c / (size.get(False, 0) + 1 - c))
    score = odds / F.sqrt(1 / a + 1 / c)
    telling = counts.where(F.col("a") > 1).where(odds > TELLING).orderBy(score.desc(), F.length("string").desc(), "string").limit(50 * TOXIC_LANDMARKS).collect()
    chosen: list[str] = []
    for row in telling:  # the best of each family of similar strings
        if len(chosen) < TOXIC_LANDMARKS and not any(max(_alike(row["string"], x), _alike(x, row["string"])) > 0.5 for x in chosen):
            chosen.append(row["string"])
    plain = counts.orderBy(F.desc("c"), "string").limit(PLAIN_LANDMARKS).collect()
    return list(dict.fromkeys([*chosen, *(r["string"] for r in plain)]))


def _alike(string: str, landmark: str) -> float:
    return float(similarities([string], [landmark])[0, 0])


def _monotone(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Points of a rising curve from margins to the weighted share of toxic rows (pooled neighbours, a few rows at least)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for part in np.array_split(order, max(1, len(order) // 10)):
        own = weight[part]
        blocks.append([np.average(margin[part], weights=own), own[toxic[part]].sum(), own.sum()])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            at, hits, rows = blocks.pop()
            a, b, c = blocks[-1]
            blocks[-1] = [(a * c + at * rows) / (c + rows), b + hits, c + rows]
    return [b[0] for b in blocks], [(b[1] + 0.1) / (b[2] + 0.2) for b in blocks]


class Machine:
    """Landmarks, weights and the calibration of a fitted machine."""

    def __init__(self, landmarks: list[str], features: np.ndarray, toxic: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)):
        """``stands_for``: how many labelled rows one clean and one toxic row stand for."""
        self.landmarks = landmarks
        share = np.where(toxic, stands_for[1], stands_for[0])
        share = share / share.mean() if len(share) else share
        self.whiten = np.zeros((3 * len(landmarks), 3 * len(landmarks)))
        self.weights = np.zeros(3 * len(landmarks) + 1)
        self.steps = [0.0], [float((share[toxic].sum() + 0.5) / (len(toxic) + 1))]
        if not landmarks or toxic.all() or not toxic.any():
            return
        among = similarities(landmarks, landmarks).astype(float)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        self.whiten = np.kron(np.eye(3), vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T)
        x = np.hstack((features @ self.whiten, np.ones((len(features), 1))))
        y = np.where(toxic, 1.0, -1.0)
        weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
        ridge = np.diag(np.append(np.full(3 * len(landmarks), 1e-4), 1e-6))
        for _ in range(50):  # Newton steps on the rows inside the margin
            inside = y * (x @ self.weights) < 1
            xi, wi = x[inside], weight[inside][:, None]
            new = np.linalg.solve(ridge + xi.T @ (wi * xi), xi.T @ (wi[:, 0] * y[inside]))
            if np.allclose(new, self.weights, atol=1e-9):
                break
            self.weights = new
        self.steps = _monotone(x @ self.weights, toxic, share)

    def state(self) -> dict:
        """What scoring needs, as plain values."""
        return {"landmarks": self.landmarks, "direction": self.whiten @ self.weights[:-1], "bias": self.weights[-1], "steps": self.steps}


def scores(state: dict, texts: pa.Array) -> np.ndarray:
    """The chance that each text is toxic."""
    margin = text_features(texts, state["landmarks"]) @ state["direction"] + state["bias"]
    return 0.99 * np.interp(margin, *state["steps"]) + 0.01 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out():
    """Rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted on at most TOXIC_ROWS and CLEAN_ROWS labelled rows that are not held out.

    Its scores are for the mix of classes among all of these labelled rows, however many were drawn.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    )
    known = stored(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "known")
    rows = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    stands_for = tuple(max(1.0, rows.get(t, 0) / n) for t, n in ((False, CLEAN_ROWS), (True, TOXIC_ROWS)))
    turn = F.xxhash64("doc_id", F.lit("toxicity"))
    drawn = [known.where(F.col("toxic") == t).orderBy(turn, "doc_id").limit(n) for t, n in ((True, TOXIC_ROWS), (False, CLEAN_ROWS))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = stored(drawn[0].union(drawn[1]), "labelled")
    joined = texts.join(F.broadcast(sample), "doc_id")  # TOXIC_ROWS + CLEAN_ROWS ids at most
    train = stored(joined.groupBy("text").agg((F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic")), "train")
    landmarks = _landmarks(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_features(batch.column("text"), landmarks)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(rows), pa.list_(pa.float32()))], names=["toxic", "features"])

    table = train.mapInArrow(run, "toxic boolean, features array<float>").toArrow()  # a few numbers per fitted row
    features = np.array(table.column("features").to_pylist(), np.float32).reshape(len(table), 3 * len(landmarks))
    return Machine(landmarks, features, table.column("toxic").to_numpy().astype(bool), stands_for)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The machine learns from labelled rows whose crc32(doc_id) mod 3 is not 1; texts alone are its input.
    predicted is 1 where the score is ``threshold`` or more.

    Rows without id are scored and count as not held out.  A null text is empty; a text without strings
    has no features and the score of the bias alone.  Repeated rows are scored alike; repeated
    labels are averaged.  Without labels of both kinds every score is the share of toxic ones.  Extra
    columns are ignored.  An empty table gives no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(machine.value, batch.column("text")).astype(float), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), found], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
