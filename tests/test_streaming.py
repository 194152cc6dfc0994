"""Streams over stored files: batch equality, replays, profiles."""

import os
import random

import pytest

from jobsieve.operators.dedupe import dedupe_postings
from jobsieve.operators.store import upsert_postings
from jobsieve.streaming import deltas, stream

ROW = (
    "ingest_pos bigint, company_name string, job_role string, number_of_people string, job_url string, "
    "source_website string, posted_date string, published_at string, location string, posted_by string, "
    "company_slug string"
)


def row(pos, company, people="N/A"):
    slug = company.lower().replace(" ", "-")
    return (pos, company, "Clerk", people, None, "s", None, None, "N/A", "N/A", slug)


def write_files(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").json(folder)


def ingest(spark, folder):
    return stream.stream_ingest(spark, folder, ROW, files_per_batch=1)


def names(spark, path):
    return {r.company_name: (r.scrape_count, r.number_of_people) for r in deltas.read_store(spark, path).collect()}


def now(n):
    return f"2026-03-1{n} 00:00:00"


def upsert(spark, feed, path, checkpoint):
    stream.stream_upsert(ingest(spark, feed), path, str(checkpoint), now).awaitTermination()
    return names(spark, path)


def test_upsert_stream_keeps_its_state_across_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write_files(spark, one, [[row(1, "Acme Works"), row(2, "Beta Works")], [row(3, "Acme Works", "45 employees")]])
    assert upsert(spark, one, path, tmp_path / "cp1") == {"Acme Works": (1, "N/A"), "Beta Works": (1, "N/A")}
    write_files(spark, two, [[row(1, "Acme Works", "45 employees"), row(2, "Gamma Works")]])
    both = upsert(spark, two, path, tmp_path / "cp2")
    assert both == {"Acme Works": (2, "45 employees"), "Beta Works": (1, "N/A"), "Gamma Works": (1, "N/A")}

    replay = stream.upsert_batch(path, now, run_id=str(tmp_path / "cp2"))
    replay(spark.createDataFrame([row(1, "Acme Works", "45 employees"), row(2, "Gamma Works")], ROW), 0)
    assert names(spark, path) == both


def test_upsert_result_does_not_depend_on_the_batches(spark, tmp_path):
    rows = [row(1, "Acme Works"), row(2, "Beta Works"), row(3, "Acme Works", "45 employees"), row(4, "Beta Works")]
    results = []
    for name, batches in (("whole", [rows]), ("single", [[r] for r in rows])):
        write_files(spark, str(tmp_path / name), batches)
        results.append(upsert(spark, str(tmp_path / name), str(tmp_path / f"{name}-store"), tmp_path / f"{name}-cp"))
    assert results[0] == results[1] == {"Acme Works": (1, "N/A"), "Beta Works": (1, "N/A")}


def test_store_equals_one_merge_after_the_other(spark, tmp_path, monkeypatch):
    """Five batches, parts folded over two levels; blanks, changes and repeats included."""
    monkeypatch.setattr(deltas, "FAN", 2)
    rng, path = random.Random(5), str(tmp_path / "store")
    expected = deltas.read_store(spark, path)
    for n in range(5):
        rows = [
            (i, f"Firm {rng.randrange(12)}", "Clerk", rng.choice(["N/A", "", None, "5 employees"]), rng.choice([None, f"https://e.com/{n}/{i}?a"]), f"s{n}",
             rng.choice([None, f"{n} days ago"]), None, rng.choice(["N/A", "", " ", f"Town {n}"]), rng.choice([None, f"P{n}"]), "x")
            for i in range(6)
        ]
        batch = spark.createDataFrame(rows, ROW)
        at = f"2026-03-{10 + n} 00:00:00"
        deltas.Turn(spark, path, "x", n).add(batch, at)
        expected = spark.createDataFrame(upsert_postings(batch, expected, at)[0].collect(), expected.schema)
    got = deltas.read_store(spark, path)
    assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
    levels = [level for _, level in deltas._parts_of(spark, path, 5)]
    assert levels == [2, 0]
    assert deltas.read_store(spark, path, 3).agg({"scrape_count": "sum"}).first()[0] == 18


def test_unused_parts_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deltas, "FAN", 2)
    path = str(tmp_path / "store")
    for n in range(4):
        deltas.Turn(spark, path, "x", n).add(spark.createDataFrame([row(n, f"Firm {n}"), row(9, "Firm 0")], ROW), now(n))
    before = names(spark, path)
    deltas.drop_unused(spark, path, keep=1)
    assert names(spark, path) == before and before["Firm 0"][0] == 5
    assert sorted(os.listdir(f"{path}/parts")) == sorted(name for name, _ in deltas._parts_of(spark, path, 4)) == ["v4-2"]


def test_bytes_per_batch_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "store")

    def part_size(version):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{path}/parts/v{version}-0") for f in files)

    for n, size in enumerate((4000, 10, 10)):
        rows = [row(i, f"Firm {n} {i}") for i in range(size)]
        deltas.Turn(spark, path, "x", n).add(spark.createDataFrame(rows, ROW), now(n))
    assert max(part_size(2), part_size(3)) < part_size(1) / 5  # each file has a fixed footer
    assert deltas.read_store(spark, path).count() == 4020


def test_progress_counts_the_run(spark, tmp_path):
    path, feed, cp = str(tmp_path / "store"), str(tmp_path / "feed"), str(tmp_path / "cp")
    stream.upsert_batch(path, now, run_id="before")(spark.createDataFrame([row(1, "Acme Works")], ROW), 0)
    write_files(spark, feed, [
        [row(1, "Acme Works"), row(2, "2) Beta Works", "5 employees"), row(3, "Acme Works", "7 employees"), row(4, "Remote"), row(5, "Big Works", "5000 employees")],
        [row(6, "Beta Works"), row(7, "Gamma Works")],
    ])
    ingest_ = ingest(spark, feed)
    stream.stream_progress(ingest_, path, cp, now, page="source_website").awaitTermination()
    log = {r.batch: r for r in stream.progress_log(spark, path, cp).collect()}
    counters = [tuple(log[n])[:8] for n in (0, 1)]
    assert counters == [(1, 5, 2, 2, 1, 2, 1, 1), (1, 7, 3, 3, 2, 3, 2, 1)]
    assert [(j.ingest_pos, j.company_name, j.is_new) for j in log[1].recent_jobs] == [(1, "Acme Works", False), (2, "Beta Works", True), (7, "Gamma Works", True)]

    again = stream.upsert_batch(path, now, run_id=cp, progress=True, page="source_website")
    again(spark.createDataFrame([row(6, "Beta Works"), row(7, "Gamma Works")], ROW), 1)
    assert {r.batch: r for r in stream.progress_log(spark, path, cp).collect()} == log


@pytest.mark.parametrize("files", [1, 3, 8])
def test_dedupe_stream_keeps_first_arrivals_in_any_order(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [row(i, rng.choice(["Acme Works", "Acme, Works", f"Firm {i % 7}", "acme works"]), f"{i} employees") for i in range(60)]
    rng.shuffle(rows)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    write_files(spark, feed, [rows[k::files] for k in range(files)])
    firsts = stream.stream_dedupe(ingest(spark, feed))
    writer = firsts.writeStream.outputMode("update").foreachBatch(stream.emitted_batch(out))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = stream.settled(spark.read.parquet(out)).drop("dedupe_key")
    want = dedupe_postings(spark.createDataFrame(rows, ROW))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_state_of_past_horizons_goes(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    ddl = ROW + ", seen_at timestamp"
    days = ["2026-03-01 10:00:00", "2026-03-01 11:00:00", "2026-03-05 10:00:00", "2026-03-09 10:00:00"]
    for n, day in enumerate(days):
        data = spark.createDataFrame([(*row(n, "Acme"), day)], ROW + ", seen_at string")
        data.coalesce(1).write.mode("append").json(feed)
    firsts = stream.stream_dedupe(stream.stream_ingest(spark, feed, ddl, files_per_batch=1), event_time="seen_at")
    writer = firsts.writeStream.outputMode("update").foreachBatch(stream.emitted_batch(out))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = stream.settled(spark.read.parquet(out))
    assert sorted(r.ingest_pos for r in kept.collect()) == [0, 2, 3]
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2


def test_live_progress_is_bounded(spark, tmp_path):
    feed = str(tmp_path / "feed")
    write_files(spark, feed, [[row(1, "Acme"), row(2, "Beta", "5")], [row(3, "Gamma")]])
    live = stream.LiveProgress()
    spark.streams.addListener(live)
    try:
        query = stream.observed(ingest(spark, feed)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(live)
    assert live.log.maxlen == stream.RECENT
    assert [(r["jobs_discovered"], r["missing_employee_counts"]) for r in live.log] == [(2, 1), (1, 1)]


def test_profiles_are_asked_once(spark, tmp_path):
    feed, path = str(tmp_path / "feed"), str(tmp_path / "profiles")
    write_files(spark, feed, [[row(1, "Acme"), row(2, "Acme")], [row(3, "Beta"), row(4, "Acme")]])
    texts = spark.createDataFrame([("acme", "# x\n**Size:** 11-50\n")], "company_slug string, text string")
    stream.profile_refresh(
        ingest(spark, feed), texts, path, str(tmp_path / "cp"), lambda n: f"2026-03-1{n} 00:00:00"
    ).awaitTermination()
    rows = {r.company_slug: r for r in stream.latest_profiles(spark, path).collect()}
    assert {k: r.employee_count for k, r in rows.items()} == {"acme": "11-50", "beta": "N/A"}
    assert len({r.updated_at for r in rows.values()}) == 2
