"""The pipeline's stages on rows that repeat ids, on awkward and on empty tables; the model of its first stage."""

import math
from collections import Counter

import pytest
from llm_helpers import prose

import corpus_pipeline
from jobsieve.llm import neardup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_dedup_keeps_each_document_once(spark):
    a, b, c = (prose(s, 40) for s in (1, 2, 3))
    docs = table(spark, (0, a), (1, b), (1, a), (2, c), (2, c), (3, ""), (4, None), (3, ""), (None, a))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted(
        [(False, 0, a), (False, 1, b), (False, 2, c), (False, 3, ""), (False, 3, ""), (False, 4, ""), (True, None, a)], key=repr
    )


def test_links_of_repeated_ids(spark, documents):
    """Sixty texts under thirty ids, and a near copy of each."""
    texts = [(i % 30, prose(i, 50)) for i in range(60)]
    near = [(1000 + k, t + " more") for k, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(*texts, *near), words=3, threshold=85).collect()}
    assert [got[1000 + k] for k in range(60)] == [i for i, _ in texts]


def test_stages_judge_rows_of_one_id_apart(spark, tmp_path):
    items = [(1, prose(50, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, (7, prose(8, 20) + " " + items[0][1]), (7, prose(9, 60)), (8, prose(10, 60)))
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, prose(9, 60)), (8, prose(10, 60))])
    shared = prose(70, 20)
    cut = corpus_pipeline.suffix_array_dedup(spark, table(spark, (1, "A" + shared), (2, "B" + shared), (2, "unlike " + prose(71, 30)), (None, shared)), "")
    assert sorted((r.doc_id or 0, r.text) for r in cut.collect()) == sorted([(1, "A" + shared), (2, "B"), (2, "unlike " + prose(71, 30)), (0, shared)])


def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120)] + [(None, None, None), (300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(205, 40)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_whole_run(spark, tmp_path):
    rows = [(i, prose(i, 60 + i % 20)) for i in range(150)]
    copies = [(400 + i, prose(i, 60 + i % 20)) for i in range(0, 20)]
    noise = [(300 + k, "#$%!! " * 30 + str(k)) for k in range(3)]
    leak = [(500, prose(205, 40)), (500, prose(206, 70)), (501, prose(207, 70)), (501, prose(207, 70))]
    odd = [(None, prose(1, 30)), (600, None), (601, ""), (602, "  \n")]
    path = folder(spark, tmp_path, table(spark, *rows, *copies, *noise, *leak, *odd))
    got = corpus_pipeline.run(spark, path).collect()
    starts = Counter(r.doc_id for r in got if r.piece == 0)
    gone = {400 + i for i in range(20)} | {300, 301, 302, 600, 601, 602}
    assert not gone & set(starts)
    assert starts[500] == starts[501] == 1
    assert sum(starts[i] for i in range(150)) >= 140 and max(starts.values()) == 1


def test_empty_run(spark, tmp_path):
    path = folder(spark, tmp_path, table(spark).where("false"))
    got = corpus_pipeline.run(spark, path)
    assert got.collect() == [] and "sequence_id" in got.columns


def plain_perplexities(trusted, texts):
    """Interpolated modified Kneser-Ney of character trigrams, term by term."""
    def grams(text):
        padded = 2 * quality.BEGIN + text + quality.END
        return [padded[i : i + 3] for i in range(len(text) + 1)]

    three = Counter(g for t in trusted for g in grams(t))
    two = Counter(g[1:] for g in three)  # continuations: distinct letters before
    one = Counter(p[1] for p in two)

    def discounts(counts):
        n = [0] + [sum(c == k for c in counts.values()) for k in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k
            out.append(min(max(d, 0.05 * k), 0.95 * k))
        return out

    d2, d3 = discounts(two), discounts(three)
    total, kinds = sum(one.values()), len(one)
    rest = 0.5 * kinds / total / (kinds + 1)

    def p1(c):
        return (one[c] - 0.5) / total + rest if c in one else rest

    def p2(b, c):
        follows = {p: n for p, n in two.items() if p[0] == b}
        if not follows:
            return p1(c)
        s = sum(follows.values())
        freed = sum(d2[min(n, 3)] for n in follows.values()) / s
        n = follows.get(b + c, 0)
        return (n - d2[min(n, 3)] if n else 0) / s + freed * p1(c)

    def p3(a, b, c):
        follows = {g: n for g, n in three.items() if g[:2] == a + b}
        if not follows:
            return p2(b, c)
        s = sum(follows.values())
        freed = sum(d3[min(n, 3)] for n in follows.values()) / s
        n = follows.get(a + b + c, 0)
        return (n - d3[min(n, 3)] if n else 0) / s + freed * p2(b, c)

    return [math.exp(-sum(math.log(p3(*g)) for g in grams(t)) / len(grams(t))) for t in texts]


@pytest.mark.parametrize("chunk, way", [(1 << 19, 128), (50, 2)])
def test_perplexities_equal_the_plain_model(spark, documents, monkeypatch, chunk, way):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    monkeypatch.setattr(quality, "WAY_CHUNKS", way)
    texts = [prose(s, 4 + s % 9) for s in range(12)] + ["x", "日本 é", "ab" * 90, "#"]
    trusted = spark.createDataFrame([(i,) for i in range(0, 12, 2)], "doc_id long")
    docs = documents(*enumerate(texts)).select("doc_id", "text")
    got = {r.doc_id: (r.n, r.perplexity) for r in quality.perplexities(docs, trusted).collect()}
    want = plain_perplexities(texts[0:12:2], texts)
    assert {i: n for i, (n, _) in got.items()} == {i: len(t) + 1 for i, t in enumerate(texts)}
    assert [got[i][1] for i in range(len(texts))] == pytest.approx(want)
