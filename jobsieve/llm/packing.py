"""Packing of tokenised documents into sequences by swap-based local search.

Documents become token pieces of at most ``limit`` tokens; only longer documents are cut.
Pieces are dealt at random into groups of about GROUP_TOKENS tokens, as many groups as the
corpus needs, and each group is packed by one task.  A group holds about a thousand
sequences of the whole mix of lengths, so the groups together lose about one sequence in a
thousand against one single search.

In a group, best-fit decreasing makes the first sequences.  Then the sequences, emptiest first, hand their
pieces over: by a move into a gap, by an exchange of one piece for a shorter one, or of two
for one, or one for two; all pairs are looked up in sorted sums.  Each step raises the sum of squared fills, which is bounded, so
the search ends: when a pass over all sequences changes nothing, or no fewer can hold the tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from jobsieve.llm.common import identified, stored
from jobsieve.llm.wordhash import ragged

GROUP_TOKENS = 4 << 20  # tokens that one task packs
GROUP_PIECES = 50_000  # pieces that one task packs
KNOWN_WORDS = 500_000  # stems whose ids a worker remembers
SLICE = 4 << 20  # bytes of text that are tokenised together

_KNOWN: dict[str, dict[str, list[int]]] = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The letters that byte-level vocabularies write for bytes that are not printable: those from 256 on.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SIMPLE = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def _run_ids(run: str, model) -> list[int]:
    letters = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LETTERS)
    return [t.id for t in model.tokenize(letters)]


def _word_ids(words: list[str], tokenizer, known: dict[str, list[int]]) -> list[list[int]]:
    """Token ids of each word.

    A word of Latin letters and closing ASCII marks (no apostrophe) is two runs to the tokenizer, which its model
    can take directly; all other words go through the whole tokenizer.
    """
    model = tokenizer.model
    if len(known) > KNOWN_WORDS:
        known.clear()
    result: list[list[int]] = []
    rest: list[int] = []
    for word in words:
        simple = _SIMPLE(word)
        if simple is None:
            rest.append(len(result))
            result.append([])
            continue
        stem, mark = simple[1].lower(), simple[2]
        ids = known.get(stem)
        if ids is None:
            ids = known[stem] = _run_ids(stem, model)
        if mark:
            tail = known.get(mark)
            if tail is None:
                tail = known[mark] = _run_ids(mark, model)
            ids = ids + tail
        result.append(ids)
    for begin in range(0, len(rest), 10_000):
        part = rest[begin : begin + 10_000]
        for at, found in zip(part, tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
            result[at] = found.ids
    return result


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    begin = 0
    for end in (np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist() + [len(texts)]:
        if end > begin:
            yield texts[begin:end]
        begin = end


def document_ids(texts: pa.Array, tokenizer, known: dict[str, list[int]]) -> Iterator[np.ndarray]:
    """Token ids of each text.  White space only separates, so equal words get equal ids."""
    for part in _slices(texts.fill_null("")):
        words = pc.ascii_split_whitespace(part)
        coded = words.flatten().dictionary_encode()
        ids = _word_ids(coded.dictionary.to_pylist(), tokenizer, known)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        bounds = np.concatenate(([0], np.cumsum(sizes[code])))[offsets]
        for k in range(len(part)):
            own = code[offsets[k] : offsets[k + 1]]
            yield flat[ragged(begins[own], sizes[own])] if bounds[k + 1] > bounds[k] else flat[:0]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens and ``end_id``, cut at ``limit``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        known = _KNOWN.setdefault(tokenizer_path, {})
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), document_ids(batch.column("text"), tokenizer, known), strict=True):
                ids = np.concatenate((found, end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), limit)):
                    data = ids[start : start + limit].tobytes()
                    rows.append((doc, piece, start, len(data) // 4, zlib.crc32(data), data))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return docs.where("doc_id is not null").mapInArrow(run, schema)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing."""
    gaps: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(gaps, (lengths[item], -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        else:
            gap, number = limit, len(bins)
            bins.append([])
        bins[number].append(item)
        insort(gaps, (gap - lengths[item], number))
    return bins


def improve(lengths: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """Empty as many bins as moves and exchanges that raise the squared fill can.

    The bins hand their pieces over in turn, the emptiest first, until as few are left as the total length needs, or a
    whole pass over all bins finds no step.
    """
    search = _Search(lengths, bins, limit)
    fewest = -(-sum(lengths) // limit)
    found = True
    while found and search.used() > fewest:
        found = False
        for target in np.argsort(search.fill, kind="stable").tolist():
            while search.fill[target] and search.step(target):
                found = True
            if found and not search.fill[target]:
                break  # emptied: begin with the emptiest again
    return [sorted(items) for items in search.held if items]


class _Search:
    """Bins and their pieces, with the steps that raise the sum of squared fills."""

    def __init__(self, lengths: list[int], bins: list[list[int]], limit: int):
        self.size, self.limit = np.array(lengths, np.int64), limit
        self.held = [set(items) for items in bins]
        self.place = np.empty(len(lengths), np.int64)
        for number, items in enumerate(bins):
            self.place[items] = number
        self.fill = np.bincount(self.place, weights=self.size, minlength=len(bins)).astype(np.int64)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def used(self) -> int:
        return int((self.fill > 0).sum())

    def _swap(self, given: list[int], taken: list[int], target: int, to: int) -> bool:
        for items, a, b in ((given, target, to), (taken, to, target)):
            for item in items:
                self.held[a].remove(item)
                self.held[b].add(item)
                self.place[item] = b
                self.fill[a] -= self.size[item]
                self.fill[b] += self.size[item]
        self.pairs.pop(target, None)
        self.pairs.pop(to, None)
        return True

    def _pairs(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of two pieces of a bin, each sum once and ascending, with such pieces."""
        if number not in self.pairs:
            items = np.array(sorted(self.held[number]), np.int64)
            _, first, count = np.unique(self.size[items], return_index=True, return_counts=True)
            twice = [np.flatnonzero(self.size[items] == self.size[items[k]])[1] for k in first[count > 1]]
            some = items[np.sort(np.concatenate((first, np.array(twice, np.int64))))]  # two pieces of a length stand for all
            left, right = np.triu_indices(len(some), 1)
            sums, at = np.unique(self.size[some[left]] + self.size[some[right]], return_index=True)
            self.pairs[number] = sums, some[left[at]], some[right[at]]
        return self.pairs[number]

    def step(self, target: int) -> bool:
        """Take the best step that hands pieces of ``target`` over, if there is one."""
        own = np.array(sorted(self.held[target], key=lambda i: (self.size[i], i)), np.int64)
        gap = np.where((self.fill > 0) & (np.arange(len(self.fill)) != target), self.limit - self.fill, -1)
        rise = self.fill - self.fill[target]  # a gain of more than -rise raises the squared fill
        last = np.flatnonzero(np.diff(self.size[own], append=-1))  # one piece of each length
        widest = int(gap.max())
        for item in own[last[::-1]]:  # a move into the tightest gap
            if self.size[item] > widest:
                continue
            fits = np.flatnonzero((gap >= self.size[item]) & (rise + self.size[item] > 0))
            if len(fits):
                return self._swap([int(item)], [], target, int(fits[gap[fits].argmin()]))
        sums, left, right = self._pairs(target)
        given = np.concatenate((self.size[own], sums))  # one piece, or two
        order = np.argsort(given, kind="stable")
        others = np.flatnonzero(gap[self.place] > 0)
        at, more = self._largest(given[order], self.size[others], gap[self.place[others]], rise[self.place[others]])
        if len(others) and more.max() > 0:  # for one shorter piece
            best = int(more.argmax())
            k = int(order[at[best]])
            items = [int(own[k])] if k < len(own) else [int(left[k - len(own)]), int(right[k - len(own)])]
            return self._swap(items, [int(others[best])], target, int(self.place[others[best]]))
        numbers = np.flatnonzero(gap > 0).tolist()
        parts = [self._pairs(n) for n in numbers]
        where = np.repeat(np.array(numbers, np.int64), [len(p[0]) for p in parts])
        if not len(where):
            return False
        sums, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, more = self._largest(self.size[own], sums, gap[where], rise[where])
        if more.max() <= 0:
            return False
        best = int(more.argmax())  # one piece for two shorter ones
        return self._swap([int(own[at[best]])], [int(left[best]), int(right[best])], target, int(where[best]))

    @staticmethod
    def _largest(given: np.ndarray, taken: np.ndarray, gap: np.ndarray, rise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For what would be taken, the place of the largest of the ascending ``given`` that fits instead, and the gain; 0 if none."""
        at = np.searchsorted(given, taken + gap, side="right") - 1
        more = np.where(at >= 0, given[np.maximum(at, 0)] - taken, 0)
        return at, np.where((more > 0) & (rise + more > 0), more, 0)


def _pack_group(limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        bins = improve(lengths, best_fit(lengths, limit), limit)
        sequence = np.empty(len(lengths), np.int64)
        offset = np.empty(len(lengths), np.int64)
        for number, items in enumerate(bins):
            at = 0
            for item in items:
                sequence[item], offset[item] = number, at
                at += lengths[item]
        sequence += table.column("pack_group")[0].as_py() << 32
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length <= ``limit``, ids_crc32[, ids])."""
    pieces = stored(pieces, "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-total[0] // GROUP_TOKENS), -(-total[1] // GROUP_PIECES))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return (
        pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
        .groupBy("pack_group")
        .applyInArrow(_pack_group(limit), f"{fields}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs`` that has an id, with its place in a sequence.

    doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32 (of the
    little-endian 32-bit ids), sequence_id, offset and, if asked for, the ids themselves.

    Rows without id are left out.  A null or empty text is the end id alone.  Rows that repeat an id
    are packed as often as given.  Extra columns are ignored.  An empty table gives no rows.
    """
    return pack(token_pieces(identified(docs), tokenizer_path, end_id, limit, with_ids), limit)
