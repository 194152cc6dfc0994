"""Alignment of the tokens of two tokenizers by pointer jumping.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes differently.  All tokens of a
slice of texts form one array.  Each token points to the token that overlaps it and ends farthest to the
right (of equal ends: the A token); squaring the pointers, p = p[p], converges after about log2 of the
longest chain to the last A token of each group, and that terminal token is the group's label.

Links inside a group are all its A-B occurrence pairs.  They are kept as distinct id pairs with
multiplicities, per document and never one by one.  Documents are collected into chunks of a bounded
number of such pairs; a chunk tells the corpus each of its id pairs once, with the number of its
documents that hold it, so a pair that every document holds costs one row per chunk.  Pair counts are
summed by the pair, come back to the chunks that asked, and are added up per document there.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import identified, stored
from jobsieve.llm.wordhash import ragged

SLICE = 1 << 20  # characters that are tokenised and aligned together
CHUNK = 1 << 20  # distinct (document, A id, B id) of a chunk
PRODUCT = 1 << 21  # id pairs that are written out together

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabularies:
    """The two tokenizers with the bytes of each token.

    The byte-level one is read as ranks, one line of base64 bytes and an id each, which is the same
    vocabulary as its JSON form and needs no special tokens switched off.
    """

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.first_bytes = [b""] * (max(ranks.values()) + 1)
        for data, number in ranks.items():
            self.first_bytes[number] = data
        pieces = [(k, self.second.id_to_piece(k)) for k in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces]
        self.first_sizes = np.array([len(x) for x in self.first_bytes], np.int64)
        self.second_sizes = np.array([len(x) for x in self.second_bytes], np.int64)
        most = max(len(self.first_bytes), len(self.second_bytes))
        self.printed = [f"{k}{mark}".encode() for mark in ",|;" for k in range(most)]  # an id and what follows it
        self.most = most

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers per text; none where the joined bytes of either differ from space + text."""
        firsts, seconds = [], []
        pieces = self.second.encode(texts, num_threads=1)
        for text, b in zip(texts, pieces, strict=True):
            spaced = " " + text
            a = self.first.encode_ordinary(spaced) if text else []
            data = spaced.encode()
            whole = text and b"".join(map(self.first_bytes.__getitem__, a)) == data and b"".join(map(self.second_bytes.__getitem__, b)) == data
            firsts.append(np.array(a if whole else [], np.int64))
            seconds.append(np.array(b if whole else [], np.int64))
        return firsts, seconds


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups, numbered from 0 in order, of the A and of the B tokens; both sets of tokens cover the same bytes.

    The arguments are the tokens' end offsets in ascending order, where no token is empty.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)  # the B token that holds an A token's last byte
    over_b = np.searchsorted(a_ends, b_ends)
    own = np.arange(n)
    target = np.concatenate((np.where(b_ends[over_a] > a_ends, n + over_a, own), over_b))
    while True:
        jumped = target[target]
        if np.array_equal(jumped, target):
            break
        target = jumped
    number = np.cumsum(target[:n] == own) - 1  # terminals are A tokens that point to themselves
    group = number[target]
    return group[:n], group[n:]


def _per_group(group: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) and their counts."""
    keys, count = np.unique(group * most + ids, return_counts=True)
    return keys // most, keys % most, count


def linked_pairs(
    a_group: np.ndarray, a: np.ndarray, b_group: np.ndarray, b: np.ndarray, doc_of: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document, its linked id pairs a * most + b and their numbers of links: (doc, pair, links)."""
    groups = len(doc_of)
    ga, ia, ca = _per_group(a_group, a, most)
    gb, ib, cb = _per_group(b_group, b, most)
    b_starts = np.searchsorted(gb, np.arange(groups + 1))
    width = np.diff(b_starts)[ga]
    held = []
    ends = np.cumsum(width)
    begin = 0
    while begin < len(ga):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCT, "right")))
        own, reach = slice(begin, stop), width[begin:stop]
        at = ragged(b_starts[ga[own]], reach)
        pair = np.repeat(ia[own], reach) * most + ib[at]
        held.append(_summed(np.repeat(doc_of[ga[own]], reach), pair, np.repeat(ca[own], reach) * cb[at]))
        begin = stop
    if len(held) > 1:
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return held[0] if held else (np.zeros(0, np.int64),) * 3


def _summed(doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, doc))
    doc, pair, links = doc[order], pair[order], links[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return doc[at], pair[at], np.add.reduceat(links, at) if len(at) else links


def align(texts: list[str], tokens: Vocabularies) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers per text as in NUMBERS, hash of its groups, its linked pairs)."""
    firsts, seconds = tokens.encode(texts)
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    n_a = np.array([len(x) for x in firsts], np.int64)
    n_b = np.array([len(x) for x in seconds], np.int64)
    a_group, b_group = group_labels(np.cumsum(tokens.first_sizes[a]), np.cumsum(tokens.second_sizes[b]))
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    a_count, b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_ends, b_ends = np.cumsum(a_count), np.cumsum(b_count)
    doc_of = np.repeat(np.arange(len(texts)), n_a)[a_ends - 1]  # texts end groups, so a group is in one text
    numbers = np.stack((n_a, n_b, np.bincount(doc_of, minlength=len(texts)), np.bincount(doc_of, a_count * b_count, len(texts)).astype(np.int64)))
    # every token with the mark that follows it, in the order A of group 0, B of group 0, A of group 1, ...
    marked = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), bool)
    last[a_ends - 1] = True
    marked[np.arange(len(a)) + (b_ends - b_count)[a_group]] = a + np.where(last, tokens.most, 0)
    last = np.zeros(len(b), bool)
    last[b_ends - 1] = True
    marked[np.arange(len(b)) + a_ends[b_group]] = b + np.where(last, 2 * tokens.most, 0)
    bounds = np.concatenate(([0], np.cumsum(n_a + n_b)))
    hashes = []
    for k in range(len(texts)):
        written = b"".join(map(tokens.printed.__getitem__, marked[bounds[k] : bounds[k + 1]].tolist()))
        hashes.append(hashlib.sha256(written[:-1]).hexdigest() if written else "")
    return numbers, hashes, linked_pairs(a_group, a, b_group, b, doc_of, tokens.most)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            ids.append(batch.column("doc_id")[k].as_py())
            texts.append(batch.column("text")[k].as_py())
            size += len(texts[-1])
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _chunks(paths: tuple[str, str, str]):
    """Rows of two kinds: a chunk's documents, packed, and its distinct pairs with the documents that hold them."""
    schema = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("holders", pa.int32()), ("docs", pa.binary())])

    def rows(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        pair = np.concatenate([links[1] for _, links in held])
        pairs, code, holders = np.unique(pair, return_inverse=True, return_counts=True)
        blobs, at = [], 0
        for head, (doc, own, links) in held:
            mine = code[at : at + len(own)].astype(np.int32)
            at += len(own)
            blobs.append(zstandard.compress(pickle.dumps((*head, np.bincount(doc, minlength=len(head[0])), mine, links), protocol=5), 3))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(blobs), pa.int64()), pa.nulls(len(blobs), pa.int64()), pa.nulls(len(blobs), pa.int32()), pa.array(blobs, pa.binary())],
            schema=schema,
        )
        for k in range(0, len(pairs), 1 << 16):
            own = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(holders[k : k + len(own)].astype(np.int32)), pa.nulls(len(own), pa.binary())],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabularies(*paths)
        chunk = TaskContext.get().partitionId() << 32  # unique, and the same when the task runs again
        held, size = [], 0
        for ids, texts in _slices(batches):
            numbers, hashes, links = align(texts, tokens)
            held.append(((ids, numbers, hashes), links))
            size += len(links[0])
            if size >= CHUNK:
                yield from rows(chunk, held)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield from rows(chunk, held)

    return run


def _answers(key, chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums of their pairs' counts."""
    order = np.argsort(counts.column("pair").to_numpy())  # as the chunk numbered its distinct pairs
    count = counts.column("count").to_numpy()[order]
    best = counts.column("best").to_numpy(zero_copy_only=False)[order]
    parts = []
    for blob in chunk.column("docs"):
        ids, numbers, hashes, sizes, code, links = pickle.loads(zstandard.decompress(blob.as_py()))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        n_best = np.concatenate(([0], np.cumsum(np.where(best[code], links, 0))))
        total = np.concatenate(([0], np.cumsum(count[code] * links)))
        columns = [pa.array(ids, pa.int64()), *map(pa.array, numbers), pa.array(np.diff(n_best[ends])), pa.array(np.diff(total[ends])), pa.array(hashes, pa.string())]
        parts.append(pa.table(columns, names=["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(parts)


def align_tokenizers(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> tuple[DataFrame, DataFrame]:
    """The documents' alignments, and the corpus-wide table of linked id pairs.

    The first result has (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of
    ``docs`` with an id: numbers of tokens, groups and links; links whose pair count is the highest of its A id
    (ties included); sum of the links' pair counts; and the SHA-256 of the groups written as ``a1,a2|b1;a3|b2``.
    The second has (a, b, count, best): how many rows hold the pair linked, and whether no pair of its A id has
    a higher count.

    Groups are cut at byte offsets where a token of each tokenizer ends.  A null or empty text, and one whose
    joined token bytes are not those of space + text in both vocabularies, has no tokens: zeros and ''.  Rows
    without id are left out; repeated rows count and are returned as often as they occur.  Extra columns are
    ignored.  An empty table gives no rows.
    """
    most = Vocabularies(ranks_path, pattern, model_path).most
    chunks = stored(
        identified(docs).mapInArrow(_chunks((ranks_path, pattern, model_path)), "chunk long, pair long, holders int, docs binary"), "aligned", codec="zstd"
    )
    told = chunks.where("pair is not null")
    counts = told.groupBy("pair").agg(F.sum("holders").alias("count"))
    a, b = F.expr(f"pair div {most}").cast("int"), F.expr(f"pair % {most}").cast("int")
    pairs = stored(counts.select("pair", a.alias("a"), b.alias("b"), "count"), "pairs", codec="zstd")
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))  # at most one row per id of the vocabulary
    table = pairs.join(F.broadcast(highest), "a").select("pair", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    found = told.select("chunk", "pair").join(table.select("pair", "count", "best"), "pair").select("chunk", "pair", "count", "best")
    packed = chunks.where("docs is not null").select(F.col("chunk").alias("own"), "docs")
    result = packed.groupBy("own").cogroup(found.groupBy("chunk")).applyInArrow(_answers, RESULT)
    return result, table.drop("pair")
