"""Tokenizer alignment against brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from llm_helpers import prose

from jobsieve.llm import alignment

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def printable():
    """Byte of each letter of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def groups_of(text, coders):
    """[(A ids, B ids)] of each group, token by token."""
    first, second = coders
    letters = printable()
    spaced = " " + text
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(spaced, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or b"".join(x for _, x in a) != spaced.encode() or b"".join(x for _, x in b) != spaced.encode():
        return []

    out, group, at = [], ([], []), [0, 0]
    queues = [list(reversed(a)), list(reversed(b))]
    while any(queues):
        which = 0 if at[0] <= at[1] else 1
        number, data = queues[which].pop()
        group[which].append(number)
        at[which] += len(data)
        if at[0] == at[1]:
            out.append(group)
            group = ([], [])
    return out


def brute(texts, coders):
    groups = [groups_of(t or "", coders) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    rows = []
    for g, own in zip(groups, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(written.encode()).hexdigest() if g else "",
        ))
    return rows, count


@pytest.mark.parametrize("chunk, product", [(1 << 20, 1 << 21), (40, 7)])
def test_alignment_equals_brute_force(spark, documents, coders, monkeypatch, chunk, product):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "SLICE", 10 * chunk)
    monkeypatch.setattr(alignment, "PRODUCT", product)
    texts = [
        prose(1, 80), prose(1, 80), "", None, " ", "\n\n  x \t", "a▁b", "日本語のテキスト、\U0001f600\U0001f1e9!", "=" * 500 + "-" * 77,
        "It's <|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x7f 　é", " " * 300 + "x", "Ééanon tionç 12345 3.14", prose(2, 300), "x",
    ]
    want, count = brute(texts, coders)
    aligned, table = alignment.align_tokenizers(documents(*enumerate(texts)).coalesce(2), *PATHS)
    got = {r.doc_id: tuple(r)[1:] for r in aligned.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a, r.b): r["count"] for r in table.collect()} == dict(count)


def test_alignment_of_awkward_and_empty_tables(spark, awkward, nothing, coders):
    want, _ = brute([r.text for r in awkward.where("doc_id is not null").orderBy("doc_id").collect()], coders)
    got = [tuple(r)[1:] for r in alignment.align_tokenizers(awkward.coalesce(2), *PATHS)[0].orderBy("doc_id").collect()]
    assert got == want
    assert alignment.align_tokenizers(nothing, *PATHS)[0].collect() == []
