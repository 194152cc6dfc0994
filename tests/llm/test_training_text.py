"""The operators against brute force on small tables, and on awkward and empty ones."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from jobsieve.llm import decontaminate, fingerprints, licenses, neardup, packing, quality, sharding, suffix_dedup, toxicity, warc
from jobsieve.llm.common import components

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def variants(base, seed, n):
    words, out = base.split(), []
    for k in range(n):
        own = list(words)
        for j in range(k % 5):
            own[(seed * 31 + k * 17 + j * 11) % len(own)] = f"z{seed}q{k}r{j}"
        out.append(" ".join(own))
    return out


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (2, 1)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    texts = [t for s in range(4) for t in variants(prose(s, 50 + 60 * s), s, 14)] + ["", "a b", "A  b", "a", "a b c d"]
    sets = [shingles(t, 3) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = by_id(neardup.near_duplicates(documents(*enumerate(texts)), words=3, threshold=85))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), top(i), top(i) == i) for i in range(len(texts))
    }


@pytest.mark.parametrize("n, m, threshold", [(128, 150, 85), (127, 149, 85), (129, 151, 85), (128, 160, 80), (128, 156, 80)])
def test_links_across_the_sketch_boundary(spark, documents, n, m, threshold):
    pairs = 40
    words = [[f"s{s}w{k}" for k in range(m + 2)] for s in range(pairs)]
    rows = [(2 * s, " ".join(words[s][: n + 2])) for s in range(pairs)] + [(2 * s + 1, " ".join(words[s])) for s in range(pairs)]
    assert all(100 * len(shingles(rows[s][1], 3) & shingles(rows[pairs + s][1], 3)) >= threshold * m for s in range(pairs))
    got = by_id(neardup.near_duplicates(documents(*rows), words=3, threshold=threshold))
    assert [i for i, r in got.items() if r.component_id != i - i % 2] == []


@pytest.mark.parametrize("batch", [3, 1000])
def test_suffix_dedup_equals_brute_force(spark, documents, batch):
    passage = prose(99, 30)
    texts = [prose(1, 40) + passage + prose(2, 10), passage, "x" * 300, prose(3, 20), "é" * 60 + passage[:55], "x" * 120, passage, "short", "ab" * 80, "ab" * 40]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, batch)
    try:
        got = by_id(suffix_dedup.remove_repeats(documents(*enumerate(texts)), 50))
    finally:
        spark.conf.set(limit, before)
    seen = set()
    for i, text in enumerate(texts):
        data = text.encode()
        gone = bytearray(len(data))
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(data), sum(gone), spans, kept)
    cut = by_id(suffix_dedup.shorten_repeats(documents(*enumerate(texts)), 50))
    assert cut[1].text == "" and cut[3].text == texts[3] and cut[0].n_chars == len(texts[0])


def test_pipeline_cuts_short_repeats(spark, documents):
    import corpus_pipeline

    passage = " ".join("the of and to in is it on".split()[k * k % 8] + chr(97 + k // 26) + chr(97 + k % 26) for k in range(30))
    assert 50 < len(passage) < 200
    got = by_id(corpus_pipeline.suffix_array_dedup(spark, documents((1, "A" + passage), (2, "B" + passage), (3, passage[:49])), ""))
    assert [got[i].text for i in (1, 2, 3)] == ["A" + passage, "B", passage[:49]]


def test_shards_are_even_whole_and_gapless(spark, documents):
    rows = [(i, prose(i % 300, 20 + i % 50)) for i in range(900)] + [(1000 + i, "hot " * 40) for i in range(500)]
    got = sharding.shard_by_bytes(documents(*rows)).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    total = sum(r.size for r in got)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) < 0.02 * total
    groups = {}
    for r in got:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 8


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    texts = [prose(i, 5 + 37 * (i % 23)) for i in range(60)] + ["", "it's <|endoftext|> DON'T Été nº1 café!! a1b2", "日本 x"]
    got = packing.pack_documents(documents(*enumerate(texts)), TOKENS, end_id=1, limit=512, with_ids=True).collect()
    whole = Tokenizer.from_file(TOKENS)
    for i, text in enumerate(texts):
        ids = whole.encode(text, add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        data = b"".join(bytes(r.ids) for r in own)
        assert [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)] == ids
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids) for r in own)
        assert [r.start for r in own] == list(range(0, len(ids), 512))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(sequences) <= 1.03 * sum(r.length for r in got) / 512 + 1


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 5, 5]
    bins = packing.improve(lengths, [[0], [1], [2, 4], [3, 5]], 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_local_search_goes_on_past_stuck_bins():
    rng = random.Random(7)
    for low, high, n, share in ((900, 2200, 1500, 1.04), (300, 1500, 1500, 1.0), (1, 900, 1500, 1.0)):
        lengths = [rng.randint(low, high) for _ in range(n)]
        bins = packing.improve(lengths, packing.best_fit(lengths, 4096), 4096)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
        assert len(bins) <= share * -(-sum(lengths) // 4096) + 0.5


def test_peeling_recovers_exact_differences(spark, documents):
    lines = [f"line {k} {prose(k, 4)}" for k in range(400)]
    texts = ["\n".join(lines), "\n".join(lines[:200] + ["new"] * 3 + lines[250:]), "", "a", "a"]
    df = documents(*enumerate(texts)).select("doc_id", fingerprints.paragraph_digests(F.col("text")).alias("own"))
    df = df.withColumn("cells", fingerprints.sketch_cells("own"))
    pairs = df.alias("x").join(df.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select(
        F.col("x.doc_id").alias("i"), F.col("y.doc_id").alias("j"), F.col("x.own").alias("a"), F.col("y.own").alias("b"),
        F.col("x.cells").alias("a_cells"), F.col("y.cells").alias("b_cells"),
    )
    got = {(r.i, r.j): r.near for r in fingerprints.likeness(pairs, ["i", "j"], {"near": ("a", "b")}).collect()}
    sets = [set(t.split("\n")) - {""} for t in texts]
    for (i, j), near in got.items():
        both = len(sets[i]) + len(sets[j])
        assert near == pytest.approx(1 - len(sets[i] ^ sets[j]) / both if both else 1)
    assert len(got) == 10


def test_quality_rejects_noise_and_keeps_prose(spark, documents):
    good = [(i, prose(i, 80)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "#$%!!" for w in prose(i, 60).split())) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify_quality(documents(*good, *bad), labels))
    assert not any(got[i].kept for i, _ in bad) and sum(got[i].kept for i, _ in good) >= 195
    assert got[0].n == len(good[0][1]) + 1


def test_quality_is_not_bound_by_odd_trusted_rows(spark, documents):
    good = [(i, prose(i, 80)) for i in range(400)] + [(400 + i, "#$%! ~^& " * 20) for i in range(4)]
    bad = [(1000 + i, " ".join([w.capitalize()] * 60)) for i, w in enumerate(prose(3, 40).split())]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad[:20]], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify_quality(documents(*good, *bad), labels))
    assert not any(got[i].kept for i, _ in bad)
    assert sum(got[i].kept for i, _ in good) >= 380


def test_toxicity_tolerates_gaps(spark, documents):
    def text(i):
        return prose(i, 30) + (" you dreadful nincompoop " if i % 4 == 0 else " you cheerful fellow ") + prose(i + 500, 30)

    rows = [(i, text(i)) for i in range(400)] + [(900, prose(3, 20) + " n-inxcom-poop " + prose(4, 9)), (901, prose(3, 29))]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score_toxicity(documents(*rows), labels))
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[900].score > got[901].score and got[901].predicted == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_toxicity_scores_keep_their_meaning_when_rows_are_drawn(spark, documents, monkeypatch):
    # one text in three with the word is toxic, and no text without it
    rows = [(i, prose(1, 20) + (" you dreadful nincompoop " if i % 10 < 3 else " ") + prose(i + 5000, 3) + f" {i}") for i in range(1800)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 100)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 200)
    got = by_id(toxicity.score_toxicity(documents(*rows), labels))
    said = [got[i].score for i, _ in rows if i % 10 < 3]
    assert 0.2 < sum(said) / len(said) < 0.48


def test_leaks_are_found_with_edits(spark, documents):
    item = prose(77, 40)
    words = item.split()
    edited = " ".join(words[:3] + ["changed"] + words[4:])
    docs = documents((1, prose(1, 50) + " " + item + ". " + prose(2, 9)), (2, edited.upper()), (3, prose(3, 90)), (4, " ".join(words[:12])), (5, "tiny item"))
    items = spark.createDataFrame([(1, item), (2, prose(88, 30)), (3, None), (4, ""), (5, "Tiny item!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 5)}
    assert got[1, 1].similarity == 1 and got[1, 1].start_word == 50 and got[1, 1].n_words == 40
    assert 0.8 <= got[2, 1].similarity < 1


def test_license_places_and_templates(spark, documents):
    text = "Intro mit\nlicense\nThis work IS licensed under the GNU General Public License version 3\nUnder CC BY SA 4.0 licensed now"
    got = by_id(licenses.scan_licenses(documents((1, text), (2, "commit licensee"))))
    assert got[1].base_labels == "cc-by,gpl,mit" and "gpl-3.0" in got[1].labels and "cc-by-sa-4.0" in got[1].labels
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (3, 1, 16)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (2, 0, None, "", 0)


def test_templates_need_their_telling_words(spark, documents):
    texts = {
        "Licensed under CC BY 4.0": "cc-by",
        "This work is licensed under the GNU General Public License, version 2.": "gpl",
        "It was released under the license of its author": "",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "This library is licensed\nunder the GNU Lesser General Public License.": "lgpl",
        "Released under\nthe MIT License.": "mit",
    }
    got = by_id(licenses.scan_licenses(documents(*enumerate(texts))))
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())


def test_wrapped_licenses_are_found(spark, documents):
    wrapped = {
        "bsd": "x\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted.",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "gpl-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License,\nversion 2.",
        "unlicense": "\n".join("This is free and unencumbered software released into the public domain.".split()),
    }
    far = "Redistribution and use in source and binary forms\n" + prose(1, 40) + "\nwith or without modification, are permitted"
    got = by_id(licenses.scan_licenses(documents(*enumerate([*wrapped.values(), far, far.replace("\n", "\n\n")]))))
    assert [label in got[i].labels.split(",") and got[i].score == 1 for i, label in enumerate(wrapped)] == [True] * 4
    assert got[4].labels == got[5].labels == ""


def test_warc_records_are_linked(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><script>x()</script></head><body><p>Hi<br>there <a href="/x">you</a></p><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "https://e.com/", html), (2, None, None)], "page_id long, url string, html string")
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    got = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(got) == 4 and all(r.refers_to == source[k[0]].record_id for k, r in got.items())
    text, fields = got[1, "conversion"], got[1, "metadata"]
    assert text.content == "Hi\nthere you" and text.payload_digest == "sha1:" + hashlib.sha1(html.encode()).hexdigest()
    assert "title: A & B\r\nlanguage: en\r\n" in fields.content and "outlink: /x\r\n" in fields.content
    assert text.source_headers == fields.source_headers == source[1].headers and got[2, "conversion"].content == ""
    record = warc.warc_text(warc.derive(warc.responses(pages)), "2026-03-10T15:30:00Z").where("page_id = 1").first().record
    head, body = record.split("\r\n\r\n", 1)
    names = [line.split(": ")[0] for line in head.split("\r\n")]
    assert names == ["WARC/1.1", "WARC-Type", "WARC-Date", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Block-Digest",
                     "WARC-Payload-Digest", "Content-Type", "Content-Length"]
    assert len(body.encode()) == int(head.rsplit(" ", 1)[1]) + 4 and "\r\nWARC-Date: 2026-03-10T15:30:00Z\r\n" in head


def test_warc_records_of_awkward_pages(spark):
    schema = "page_id long, url string, html string, headers string, payload string, content string, record_id string"
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "u", "x"), (3, None, None), (4, "", ""), (5, "u", "<b>" + "long " * 100_000)]
    pages = spark.createDataFrame([(*r, None, None, None, "own") for r in rows], schema)
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 2 * len(rows)
    assert len({r.record_id for r in got}) == 2 * (len(rows) - 1)  # equal responses give equal records
    texts = {(r.page_id, r.content) for r in got if r.record_type == "conversion" and r.page_id != 5}
    assert texts == {(1, "a"), (None, "x"), (3, ""), (4, "")}
    long = next(r for r in got if r.page_id == 5 and r.record_type == "conversion")
    assert long.content == ("long " * 100_000).strip() and long.content_length == len(long.content)
    assert warc.derive(warc.responses(pages.where("false"))).collect() == []


def calls(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(5, 60)), (None, None)], "item_id long, text string")
    return {
        "leaks": lambda d: decontaminate.find_leaks(d, items),
        "licenses": licenses.scan_licenses,
        "shards": sharding.shard_by_bytes,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "fingerprints": fingerprints.fingerprint_edits,
        "quality": lambda d: quality.classify_quality(d, labels),
        "near": neardup.near_duplicates,
        "packing": lambda d: packing.pack_documents(d, TOKENS),
        "suffix": lambda d: suffix_dedup.remove_repeats(d, 50),
        "shorten": lambda d: suffix_dedup.shorten_repeats(d, 50),
    }


ROWS = {"leaks": 2, "licenses": 12, "shards": 12, "toxicity": 12, "fingerprints": 10, "quality": 9, "near": 10, "suffix": 10, "shorten": 12}


@pytest.mark.parametrize("name", ["leaks", "licenses", "shards", "toxicity", "fingerprints", "quality", "near", "packing", "suffix", "shorten"])
def test_awkward_and_empty_tables(spark, awkward, nothing, name):
    rows = calls(spark)[name](awkward).collect()
    if name in ROWS:
        assert len(rows) == ROWS[name]
    assert calls(spark)[name](nothing).collect() == []
