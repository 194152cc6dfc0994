"""Operators on small tables: order, repeats, hot keys, plans."""

import pytest
from pyspark.sql import functions as F

from jobsieve import schema
from jobsieve.operators import classify, dedupe, enrich, filters, metrics, route, spread, store, topk
from jobsieve.operators.rules import KeywordRule, terms_frame

POSTING = (
    "ingest_pos bigint, company_name string, job_role string, number_of_people string, job_url string, "
    "source_website string, posted_date string, published_at string, location string, posted_by string"
)


def posting(pos, company="Acme", role="Engineer", people="N/A", url=None, source="himalayas.app",
            posted=None, published=None, location="N/A", by="N/A"):
    return (pos, company, role, people, url, source, posted, published, location, by)


def frame(spark, rows):
    return spark.createDataFrame(rows, POSTING)


def test_dedupe_first_arrival_wins(spark):
    rows = [
        posting(2, "B", url="https://e.com/jobs/1#top"), posting(1, "A", url="https://e.com/jobs/1?utm=x"),
        posting(3, "ABC Technologies", "Software Engineer"), posting(4, "abc technologies", "software engineer"),
        posting(5, "ABC Technologies", "Senior Software Engineer"), posting(6, "日本", "役"), posting(7, "東京", "職"),
    ]
    kept = dedupe.dedupe_postings(frame(spark, rows))
    assert sorted(r.ingest_pos for r in kept.collect()) == [1, 3, 5, 6]
    assert dedupe.duplicates_count(frame(spark, rows)).first()[0] == 3
    flagged = {r.ingest_pos: r.is_duplicate for r in dedupe.mark_duplicates(frame(spark, rows)).collect()}
    assert sorted(p for p, dup in flagged.items() if dup) == [2, 4, 7]


def test_dedupe_uses_one_exchange(spark):
    plan = dedupe.dedupe_postings(frame(spark, [posting(1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_valid_record_needs_different_names(spark):
    rows = [posting(1, "TELUS Digital", "TELUS Digital"), posting(2, "TELUS Digital", "Reviewer"),
            posting(3, "日本", "役"), posting(4, "Remote", "Reviewer")]
    assert [r.ingest_pos for r in filters.valid_record(frame(spark, rows)).collect()] == [2]


def test_upsert_folds_a_batch_and_keeps_identity(spark):
    empty = spark.createDataFrame([], schema.STORE)
    first = [
        posting(1, people="N/A", url="https://e.com/1?a=1", location="Rome", published="1773100800"),
        posting(2, people="11-50", url="https://e.com/1?a=2", location="N/A", source="other"),
        posting(3, "Beta", "Clerk"),
    ]
    stored, delta = store.upsert_postings(frame(spark, first), empty, "2026-03-10 10:00:00")
    rows = {r.company_name: r for r in stored.collect()}
    acme = rows["Acme"]
    assert (acme.number_of_people, acme.location, acme.source_website, acme.scrape_count) == (
        "11-50", "Rome", "himalayas.app", 2,
    )
    assert acme.job_url == "https://e.com/1?a=2" and acme.published_at == "2026-03-10 00:00:00"
    assert all(r.is_new for r in delta.collect())

    second = [posting(1, people="", url="https://e.com/1", location="")]
    again, delta = store.upsert_postings(frame(spark, second), stored, "2026-03-11 10:00:00")
    acme = {r.company_name: r for r in again.collect()}["Acme"]
    assert (acme.number_of_people, acme.location, acme.scrape_count) == ("11-50", "Rome", 3)
    assert str(acme.first_seen_at) == "2026-03-10 10:00:00" and str(acme.last_seen_at) == "2026-03-11 10:00:00"
    assert [(r.is_new, r.batch_rows) for r in delta.collect()] == [(False, 1)]


def test_new_vs_existing_marks_only_the_first_new_row(spark):
    known = store.with_fingerprint(frame(spark, [posting(1, "Old")]))
    batch = frame(spark, [posting(1, "Old"), posting(2, "New"), posting(3, "New")])
    split = {r.ingest_pos: r.is_new for r in store.new_vs_existing(batch, known).collect()}
    assert split == {1: False, 2: True, 3: False}


def test_snapshot_versions_and_buckets(spark, tmp_path):
    rows = store.upsert_postings(
        frame(spark, [posting(i, f"C{i}") for i in range(20)]), spark.createDataFrame([], schema.STORE), "2026-03-10"
    )[0]
    path = str(tmp_path / "store")
    store.write_snapshot(rows, path, 1)
    assert store.read_snapshot(spark, path, 1).count() == 20
    table = store.write_snapshot(store.read_snapshot(spark, path, 1), path, 2, buckets=4)
    merged = spark.table(table).groupBy("fingerprint").count()
    assert merged.count() == 20
    assert "Exchange hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString()


def test_bucketed_snapshots_are_merged_without_a_shuffle_of_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = store.upsert_postings(frame(spark, [posting(i, f"Firm {i}") for i in range(50)]), spark.createDataFrame([], schema.STORE), "2026-03-10 00:00:00")[0]
    store.write_snapshot(rows, path, 1, buckets=8)
    held = store.read_snapshot(spark, path, 1, buckets=8)
    assert sorted(map(repr, held.collect())) == sorted(map(repr, store.read_snapshot(spark, path, 1).collect()))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        merged, _ = store.upsert_postings(frame(spark, [posting(60, "Firm 7")]), held, "2026-03-11 00:00:00")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        scan = next(k for k, line in enumerate(plan.split("\n")) if "SelectedBucketsCount: 8 out of 8" in line)
        above = [line for line in plan.split("\n")[:scan] if "Join" in line or "Exchange" in line]
        assert "Join" in above[-1]  # nothing is exchanged between the scan and the join
    finally:
        spark.conf.set(limit, before)
    assert merged.count() == 50


def test_align_schema_adds_columns(spark):
    old = spark.createDataFrame([("f", 1773100800)], "fingerprint string, published_at bigint")
    row = store.align_schema(old).first()
    assert row.published_at == "2026-03-10 00:00:00" and row.location is None


def profiles(spark, rows):
    return spark.createDataFrame(rows, "company_slug string, company_name string, employee_count string, profile_pos bigint")


def test_enrichment_order_and_both_join_forms(spark):
    rows = [posting(1, "Acme", url="https://e.com/companies/Other/jobs/1"), posting(2, "Acme"),
            posting(3, "Acme", people="None"), posting(4, "No one", people=""), posting(5, "Acme", people="7")]
    dim = profiles(spark, [("other", "Other", "1-10", 1), ("acme", "Acme", "11-50", 2), ("x", "X", "", 3)])
    expected = {1: "1-10", 2: "11-50", 3: "11-50", 4: "N/A", 5: "7"}
    small = enrich.enrich_headcount(frame(spark, rows), dim)
    assert {r.ingest_pos: r.number_of_people for r in small.collect()} == expected
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        salted = enrich.enrich_headcount(frame(spark, rows), dim)
        assert {r.ingest_pos: r.number_of_people for r in salted.collect()} == expected
        plan = salted._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "_way" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_backfill_headcount_last_profile_wins(spark):
    rows = [posting(1, "Acme", url="https://e.com/companies/beta-x/1"), posting(2, "Acme"),
            posting(3, "Zed", url="https://e.com/T2/1"), posting(4, "Acme", source="other")]
    dim = profiles(spark, [("beta-x", "Beta", "1-10", 5), ("acme", "Acme", "11-50", 2), ("t2", "T2", "7", 1),
                           ("acm", "None", "N/A", 9)])
    expected = {1: "1-10", 2: "11-50", 3: "7", 4: "N/A"}
    got = enrich.backfill_headcount(frame(spark, rows), dim, "himalayas.app")
    assert {r.ingest_pos: r.number_of_people for r in got.collect()} == expected


def test_classification_is_ordered_and_by_substring(spark, apply):
    assert apply(["Sales Director", "Curiosity officer", "React software engineer", "Clerk"], classify.classify_role) == [
        "Management", "Mobile", "SDE", "Other",
    ]
    hits = classify.keyword_match(frame(spark, [posting(1, role="JavaScript lead")])).collect()
    assert [h.keyword for h in hits] == ["Java"]


def test_category_overview_counts_distinct_postings_once(spark):
    rows = [posting(1, "A", "QA engineer Selenium", "1 - 10 employees"), posting(2, "a", "qa engineer selenium"),
            posting(3, "A", "Clerk"), posting(4, "A", "QA lead", "500 employees")]
    counts = {
        (r.category_id, r.keyword): (r.total_jobs, r.under_100_jobs)
        for r in metrics.category_overview(frame(spark, rows)).collect()
    }
    assert counts[("qa_automation", "(all)")] == (1, 1)
    assert counts[("qa_automation", "QA & SDET")] == (2, 1)
    assert counts[("fde", "(all)")] == (0, 0)


def test_positions_equal_a_window_even_for_one_hot_group(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 100 < 90, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("grp"),
        F.xxhash64("id").alias("k"),
    )
    placed = spread.with_position(df, ["k"], by=["grp"])
    check = placed.selectExpr("position", "row_number() OVER (PARTITION BY grp ORDER BY k) AS expected")
    assert check.filter("position <> expected").count() == 0 and placed.count() == 20_000


def test_early_stop_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "_BLOCK", 7)
    flags = [True] * 12 + [False] * 8 + [True] + [False] * 25
    df = spark.createDataFrame([(i, "r", f) for i, f in enumerate(flags)], "ingest_pos bigint, run string, is_new boolean")
    kept = topk.early_stop_prefix(df, threshold=10)
    assert kept.count() == 12 + 8 + 1 + 10
    assert topk.early_stop_prefix(df, threshold=26).count() == len(flags)


def test_large_slices_and_wildcards(spark, monkeypatch):
    df = frame(spark, [posting(i, role=f"r{i}", source="instahyre.com") for i in range(300)])
    monkeypatch.setattr(topk, "TOP_ROWS", 10)
    assert sorted(r.ingest_pos for r in topk.position_slice(df, 100, 50).collect()) == list(range(100, 150))
    assert {r.job_role for r in topk.search_roles(df, "r1_7", 50).collect()} == {f"r1{d}7" for d in range(10)}


def test_new_only_falls_back_when_nothing_is_new(spark):
    rows = spark.createDataFrame([(1, False), (2, False)], "i int, is_new boolean")
    assert filters.new_only(rows).count() == 2
    assert filters.new_only(rows, fallback=False).count() == 0
    assert filters.new_only(rows.union(spark.createDataFrame([(3, True)], "i int, is_new boolean"))).count() == 1


def test_tabs_and_export_rows(spark):
    rows = frame(spark, [posting(1, people="1 - 10 employees"), posting(2, people="More than 1000 employees"),
                         posting(3)]).withColumn("is_new", F.col("ingest_pos") == 1)
    tabs = route.route_master_tabs(rows).groupBy("tab").count().collect()
    assert {r.tab: r["count"] for r in tabs} == {
        "All Jobs": 3, "New Jobs Only": 1, "Existing Jobs Only": 2, "Small (1-50)": 1, "Large (500+)": 1,
    }
    assert route.posting_row(rows).filter("status = 'NEW'").count() == 1
    assert route.export_name(rows, "instahyre.com").first()[0] == "Instahyre_Jobs_Master_3"


@pytest.fixture(params=["10485760", "-1"])
def broadcasts(spark, request):
    """Once with the usual broadcast limit, once without broadcasts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def test_large_slices_equal_small_ones(spark, monkeypatch):
    rows = spark.range(500).selectExpr("struct(id div 7 AS a, id % 7 AS b) AS ingest_pos", "id").repartition(6)
    cases = [(0, 10), (100, 250), (490, 100), (600, 5), (3, 0)]
    small = [[r.id for r in topk.position_slice(rows, a, n).orderBy("id").collect()] for a, n in cases]
    newest = [[r.id for r in topk.sync_limit(rows, n).collect()] for n in (250, 499, 500, 900)]
    monkeypatch.setattr(topk, "TOP_ROWS", 0)
    assert [[r.id for r in topk.position_slice(rows, a, n).orderBy("id").collect()] for a, n in cases] == small
    assert [[r.id for r in topk.sync_limit(rows, n).collect()] for n in (250, 499, 500, 900)] == newest
    assert small[1] == list(range(100, 350)) and newest[0] == list(range(499, 249, -1))


def test_backfill_with_a_piece_that_most_urls_hold(spark, broadcasts):
    urls = [(i, f"Firm {i}", f"https://e.com/companies/zzz-{i % 9}/jobs/{i}" if i % 3 else f"https://e.com/companies/ab{i}/x", "s", "N/A") for i in range(90)]
    store = spark.createDataFrame(urls, "ingest_pos long, company_name string, job_url string, source_website string, number_of_people string")
    sizes = [(f"zzz-{k}", f"N{k}", f"{k + 1} employees", k) for k in range(9)] + [("ab3", "x", "77 employees", 50), ("q", "y", "5 employees", 60), ("", "z", "6 employees", 70), ("none", "Firm 6", "8 employees", 80)]
    profiles = spark.createDataFrame(sizes, "company_slug string, company_name string, employee_count string, profile_pos long")
    got = {r.ingest_pos: r.number_of_people for r in enrich.backfill_headcount(store, profiles, "s").collect()}

    def plain(name, url):
        fit = [(pos, n) for slug, company, n, pos in sizes if company == name or (slug and slug in url.lower())]
        return max(fit)[1] if fit else "N/A"

    assert got == {i: plain(name, url) for i, name, url, _, _ in urls}


def test_application_numbers_do_not_change_on_ties(spark):
    rows = [("Eng", "2026-01-01", "same", f"n{i % 3}", str(i)) for i in range(30)]
    apps = spark.createDataFrame(rows, "role_category string, applied_at string, contact string, name string, url string")
    one = {r.url: r.row_number for r in topk.application_rownum(apps).collect()}
    two = {r.url: r.row_number for r in topk.application_rownum(apps.repartition(7, "name")).collect()}
    assert one == two and sorted(one.values()) == list(range(1, 31))


def test_rule_tables_equal_rule_lists(spark, broadcasts):
    rules = [KeywordRule("a", "A", 0, "Py", ("python", " Data ")), KeywordRule("a", "A", 1, "One", ("q",)), KeywordRule("b", "B", 0, "None", ("zzzz", "engineer"))]
    rows = [posting(i, role=r) for i, r in enumerate(["Python Data Engineer", "QA", "python", None, "", "Cook"] + ["Data Engineer"] * 40)]
    df = frame(spark, rows)
    by_list = classify.keyword_match(df, rules)
    by_table = classify.keyword_match(df, terms_frame(spark, rules))
    assert by_list.columns == by_table.columns
    assert sorted(map(repr, by_list.collect())) == sorted(map(repr, by_table.collect()))
    assert by_list.count() == 2 + 1 + 1 + 80
