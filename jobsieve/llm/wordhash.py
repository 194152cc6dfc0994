"""Hashes of words and of word shingles for whole Arrow batches of texts, with numpy.

All texts of a batch are hashed in one pass over their UTF-8 bytes, so the cost per
byte is a few array operations; nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes that are hashed together, which bounds memory
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser that loses nothing)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_A
    values = (values ^ (values >> np.uint64(27))) * _MIX_B
    return values ^ (values >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) in a row, and the offset of each text."""
    binary = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return whole[first:last], offsets - first


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about PIECE bytes that end before white space, so that no word is cut."""
    begin = 0
    while begin < len(raw):
        end, look = begin + PIECE, 1 << 10
        while end < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[end : end + look]])
            if len(spaces):
                end += int(spaces[0])
                break
            end, look = end + look, 2 * look
        yield begin, min(end, len(raw))
        begin = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, A-Z lower-cased, and where each text's words begin.

    The second array has one entry more than there are texts.
    """
    raw, offsets = text_bytes(texts)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in _pieces(raw):
        part = raw[begin:end]
        letter = ~_SPACE[part]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        inner = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        first[inner] = letter[inner]  # a text's first byte always begins a word
        at = np.flatnonzero(letter)
        if not len(at):
            continue
        begins = np.flatnonzero(first)
        place = (at - begins[np.cumsum(first[at]) - 1]).astype(np.uint64)
        parts = mix(_BYTE[_LOWER[part[at]]] + place * _BASE)
        hashes.append(mix(np.add.reduceat(parts, np.flatnonzero(first[at]))))
        starts.append(begins + begin)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words has the whole sequence as its one shingle; a text
    without words has none.
    """
    words, begins = word_hashes(texts)
    count = len(words) - size + 1
    if count > 0:
        rolled = words[:count].copy()
        for k in range(1, size):
            rolled = mix(rolled * _MIX_B + words[k : k + count] + np.uint64(k))
    else:
        rolled = np.zeros(0, np.uint64)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            short = words[a : a + 1]
            for k in range(1, b - a):
                short = mix(short * _MIX_B + words[a + k : a + k + 1] + np.uint64(k))
            yield mix(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def rolling_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling: log2(size) array steps."""
    done, hashed = 0, np.zeros(0, np.uint64)
    step, power = 1, _BYTE[raw]
    while True:
        if size & step:
            if done:
                count = max(0, len(power) - done)
                hashed = hashed[:count] * (_MIX_A + np.uint64(2 * step)) + power[done : done + count]
            else:
                hashed = power
            done += step
        if 2 * step > size:
            return mix(hashed[: max(0, len(raw) - size + 1)])
        count = max(0, len(power) - step)
        power = power[:count] * (_MIX_B + np.uint64(2 * step)) + power[step:]
        step *= 2


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (lengths[i] of them) for all i in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
