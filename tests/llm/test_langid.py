"""Language identification: subwords against a plain version, held-out accuracy, awkward tables."""

import random
import zlib

import numpy as np
import pytest

from jobsieve.llm import langid

SYLLABLES = {"xa": "ka to mi ren sol tu".split(), "xb": "schw ung eit lich ver ä".split(), "xc": "ção nho que ri é dos".split()}


def speech(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def plain_subwords(text):
    """Strings of 1 to 4 letters and word ends ('_'), not beginning or ending inside nothing."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "_" for c in f"_{text}_")
    out = []
    for n in range(1, langid.SPAN + 1):
        for i in range(len(low) - n + 1):
            gram = low[i : i + n]
            inner = gram[1:-1] if n > 2 else gram
            if ("_" not in inner) if n != 2 else gram != "__":
                out.append(gram)
    return out


@pytest.mark.parametrize("piece", [4, 7, 1 << 20])
def test_subwords_equal_the_plain_version(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = ["", "a", "12", "It's ÉTÉ, İx ßa 日本語 a-b  c!", "z" * 9, "\0x\0"]
    codes = {}
    for number, text in enumerate(texts):
        got = []
        for _, parts in langid._pieces([text]):
            got += [b for _, bucket in langid.subwords(parts) for b in bucket.tolist()]
        want = plain_subwords(text)
        assert len(got) == len(want), (number, text)
        if piece > 1000:
            codes.update(zip(want, got))
            assert sorted(codes[g] for g in want) == sorted(got)
    if piece > 1000:
        assert len(set(codes.values())) > 0.97 * len(codes)


def test_evidence_does_not_depend_on_the_pieces(monkeypatch):
    rows = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3))
    texts = [speech("xa", 1, 50), "", "12 3", speech("xc", 2, 400)]
    whole = langid._evidence(texts, rows)
    monkeypatch.setattr(langid, "PIECE", 33)
    cut = langid._evidence(texts, rows)
    assert np.allclose(whole[0], cut[0]) and whole[1].tolist() == cut[1].tolist()
    assert whole[1][1] == whole[1][2] == 0


def test_held_out_accuracy_and_rejection(spark):
    kinds = list(SYLLABLES)
    rows = [(i, speech(kinds[i % 7 % 3], i, 3 + i % 40), kinds[i % 7 % 3] if i % 10 else None) for i in range(900)]
    rows += [(2000, None, "xa"), (2001, "", "xa"), (2002, "1234 !!", "xb"), (2003, speech("xb", 5, 60) * 40, None), (2003, speech("xb", 5, 60) * 40, None), (None, "ka", "xa")]
    docs = spark.createDataFrame([(*r, "s", 1, 1.0, True) for r in rows], "doc_id long, text string, lang string, source string, n int, score double, place boolean")
    got = langid.identify_languages(docs).collect()
    assert len(got) == len(rows) - 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r for r in got}
    judged = [(by[i].lang_pred == kinds[i % 7 % 3], by[i].accepted) for i in range(900) if by[i].held_out]
    assert sum(right for right, _ in judged) >= 0.98 * len(judged)
    assert sum(right for right, ok in judged if ok) >= 0.98 * sum(ok for _, ok in judged) > 0.8 * len(judged)
    assert [(by[i].lang_pred, by[i].score, by[i].accepted) for i in (2000, 2001, 2002)] == [("und", 0.0, False)] * 3
    assert by[2003].lang_pred == "xb" and by[2003].accepted
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs.repartition(3)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in by.items()}


def test_nothing_to_learn_from(spark, awkward, nothing):
    got = langid.identify_languages(awkward).collect()  # all languages are null
    assert len(got) == awkward.where("doc_id is not null").count()
    assert {(r.lang_pred, r.score, r.accepted) for r in got} == {("und", 0.0, False)}
    assert langid.identify_languages(nothing).collect() == []


def test_labels_of_held_out_rows_are_not_learnt(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1][:40]
    docs = spark.createDataFrame([(i, "ka to", "xa") for i in ids], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_languages(docs).collect()} == {"und"}
