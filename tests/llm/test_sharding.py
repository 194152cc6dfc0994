"""Sharding against a plain version that walks over the rows."""

from bisect import bisect_right

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from jobsieve.llm import sharding


def plain(rows, shards):
    """(doc_id, size, crc, shard, slot) from (doc_id, size, crc, key, draw, spread) rows."""
    total = sum(r[1] for r in rows)
    sample = sorted(r[3] for r in rows if r[4] < r[1] * (sharding.SAMPLES / max(total, 1)))
    quantiles = sample[max(1, len(sample) // sharding.RANGES) :: max(1, len(sample) // sharding.RANGES)]
    doubled = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    splitters = sorted({*quantiles, *(k + 1 for k in doubled)})
    ranges = {}
    for r in rows:
        ranges.setdefault(bisect_right(splitters, r[3]), []).append(r)
    share, done, counts, out = max(1, total // sharding.RANGES), 0, [0] * shards, []
    for _, own in sorted(ranges.items()):
        cuts = max(1, sum(r[1] for r in own) // share) if len({r[3] for r in own}) == 1 else 1
        parts = {}
        for r in own:
            parts.setdefault(r[5] % cuts, []).append(r)
        for _, part in sorted(parts.items()):
            size = sum(r[1] for r in part)
            shard = min(shards - 1, int((done + size / 2) * shards // max(total, 1)))
            done += size
            for r in sorted(part, key=lambda r: (r[3], r[0])):
                out.append((*r[:3], shard, counts[shard]))
                counts[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("ranges, samples", [(2048, 16 * 2048), (20, 200)])
def test_shards_equal_the_plain_version(spark, documents, monkeypatch, ranges, samples):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    monkeypatch.setattr(sharding, "SAMPLES", samples)
    rows = [(i, prose(i % 170, 3 + i % 90)) for i in range(600)] + [(1000 + i, "hot " * 60) for i in range(300)] + [(2000, None), (2001, ""), (2002, "x" * 50_000)]
    docs = documents(*rows)
    text = F.coalesce("text", F.lit(""))
    draw = F.pmod(F.xxhash64("doc_id", F.xxhash64(text), F.lit("splitters")), F.lit(1 << 40)) / float(1 << 40)
    seen = docs.select(
        "doc_id", (F.octet_length(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"),
        draw.alias("draw"), F.xxhash64("doc_id").alias("spread"),
    )
    got = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_by_bytes(docs, shards=8).collect())
    assert got == plain([tuple(r) for r in seen.collect()], 8)
