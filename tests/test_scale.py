"""What a query moves and how often it evaluates a rule, read from its plan."""

from pyspark.sql import functions as F

from jobsieve import schema
from jobsieve.functions import dates, headcount, labels, predicates, text
from jobsieve.operators import classify, enrich, filters, metrics, rules, spread, store, substrings, topk
from jobsieve.operators.dedupe import with_clean_names
from jobsieve.operators.rules import KeywordRule
from jobsieve.plans import catalog, views
from jobsieve.sources import feeds


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_lookups_are_shuffled_once_and_narrow(spark):
    facts = spark.range(40).select(
        F.col("id").alias("ingest_pos"), F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("k"), F.lit("x").alias("wide")
    )
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spread.lookup_join(facts, lookup, ["k"])
        assert sorted((r.ingest_pos, r.v) for r in joined.collect()) == [
            (i, None if i % 4 == 0 else i % 5 * 10) for i in range(40)
        ]
        # no copies of the lookup rows, and no column that only a row hash would need
        assert "Generate" not in plan(joined) and "wide" not in plan(joined.select("ingest_pos", "v"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_valid_record_cleans_once(spark):
    raw = spark.createDataFrame([(1, "Acme", "Clerk", "10")], "ingest_pos int, company_name string, job_role string, employee_count_raw string")
    # the repartition keeps Spark from folding the one literal row
    rows = with_clean_names(raw.repartition(2)).withColumn("number_of_people", headcount.parse_headcount(F.col("employee_count_raw")))
    kept = filters.valid_record(rows)
    assert [tuple(r) for r in kept.select("company_name", "number_of_people").collect()] == [("Acme", "10 - 50 employees")]
    condition = kept._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[1].split("+- ", 1)[0]
    assert "employee_count_raw" not in condition


def test_case_evaluates_its_value_once():
    """Six tiers and three units used to read their number six and three times over."""
    assert headcount.headcount_sql("x").count("(?<=[0-9])_(?=[0-9])") == 2
    assert headcount.number_sql("x").count("([kmbKMB])$") == 1


def test_guards_keep_what_they_guard(apply):
    values = ["A &amp; B", "A & B", "&amp;lt;", "&ampx", "x &#38; y", "&nosuch;", "٣. Foo", "3) Bar", "a b", "é  x", "&", "&;", "tab\there"]
    assert apply(values, text.clean_company) == [
        "A & B", "A & B", "&lt", "&x", "x & y", "&nosuch", "Foo", "Bar", "a b", "é x", "&", "&", "tab here",
    ]
    sizes = ["MORE THAN 50", "over 9", "> 7", "5+ staff", "11 TO 50", "11–50", "Team size: 45", "ſtaff: 45", "45 ſtaff", "1_0", "1.2K", ",", "10,0-2"]
    assert apply(sizes, headcount.parse_headcount) == [
        "More than 50 employees", "More than 9 employees", "More than 7 employees", "More than 5 employees", "11 - 50 employees",
        "11 - 50 employees", "45 employees", "45 employees", "45 employees", "10 - 50 employees", "1,200 employees", "N/A", "10,0 - 2 employees",
    ]
    places = ["Austin, TX", "Remote, US", "Remote Labs", "Paris", "a, b", "Remote\n"]
    assert apply(places, predicates.is_location) == [True, True, False, False, False, True]


def test_early_stop_numbers_narrow_rows(spark, monkeypatch):
    numbered = []

    def with_position(df, *args, **named):
        numbered.append(df.columns)
        return spread.with_position(df, *args, **named)

    monkeypatch.setattr(topk, "with_position", with_position)
    rows = [(r, i, i < 4, "x" * 50) for r in ("a", "b") for i in range(10)] + [(None, 1, False, "x"), (None, 2, False, "x")]
    df = spark.createDataFrame(rows, "run string, ingest_pos long, is_new boolean, wide string")
    kept = topk.early_stop_prefix(df, threshold=2)
    assert sorted((r.run or "", r.ingest_pos) for r in kept.collect()) == [("", 1), ("", 2)] + [(r, i) for r in "ab" for i in range(6)]
    assert numbered == [["run", "ingest_pos", "is_new"]]


def test_numbers_are_cast_only_where_there_are_any(spark, apply):
    rule = headcount.under_100_sql("x")
    assert "try_cast(regexp_extract" not in rule  # '' as a number throws and catches an exception
    sizes = ["11-50", "99", "100+", "1,200", "none of it", "N/A", None, "50 to 100", "5-"]
    assert apply(sizes, headcount.size_under_100) == [True, True, False, False, False, False, False, True, True]


def test_keyword_tests_are_columns_of_their_own(spark):
    rules = [KeywordRule("c", "C", 1, "late", ("b",)), KeywordRule("c", "C", 0, "early", ("a",)), KeywordRule("d", "D", 0, "d", ("a",))]
    df = spark.createDataFrame([(1, "Acme", "ab", "N/A"), (2, "ACME", "AB", "N/A"), (3, "Acme", "b", "N/A")],
                               "ingest_pos int, company_name string, job_role string, number_of_people string")
    hits = classify.keyword_hits(df, rules)
    generate = next(line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
    assert "_tests0" in generate and "contains(" not in generate.lower()
    rows = classify.category_jobs(df, rules).filter("bucket = 'all' and keyword is null").collect()
    assert sorted((r.ingest_pos, r.category_id) for r in rows) == [(1, "c"), (1, "d"), (3, "c")]
    assert classify.keyword_hits(df, []).count() == 0


def test_distinct_sizes_parses_once(spark):
    raw = spark.createDataFrame([(1, "11 - 50"), (2, "N/A"), (3, None), (4, "over 9"), (5, " 11-50 staff\u00a0"), (6, "2K people")], "i int, employee_count_raw string")
    sizes = metrics.distinct_sizes(enrich.with_headcount(raw.repartition(2)))
    assert [r[0] for r in sizes.collect()] == ["11 - 50 employees", "2,000 employees", "More than 9 employees"]
    assert sizes._jdf.queryExecution().optimizedPlan().toString().count("more|over") == 1


def test_plain_text_skips_the_rules(apply):
    """The compiled tests for clean text and the rules agree at the edges."""
    values = ["Acme", "A. B, C", "Acme ", " Acme", "a  b", "A&B", "A-", "-A", "9 lives", "9) lives", "", None, "A\u00a0", "\u00a0A", "~", "A\n", "x|y"]
    assert apply(values, text.clean_company) == ["Acme", "A. B, C", "Acme", "Acme", "a b", "A&B", "A", "A", "9 lives", "lives", "", "", "A", "A", "~", "A", "x|y"]
    assert apply(values, text.clean_text) == ["Acme", "A. B, C", "Acme", "Acme", "a b", "A&B", "A-", "-A", "9 lives", "9) lives", "", "", "A", "A", "~", "A", "x|y"]
    assert apply(values, lambda c: text.strip_name(c)) == [v if v is None else v.strip() for v in values]


def test_substring_join_meets_few_candidates(spark, monkeypatch):
    """Patterns that share all their three-letter pieces; before, each text met most of them."""
    met = []

    def many_join(*args):
        met.append(spread.many_join(*args))
        return met[-1]

    monkeypatch.setattr(substrings, "many_join", many_join)
    names = [f"{i:012b}" for i in range(4096)]
    texts = spark.createDataFrame([(f"x{n}y",) for n in names[:200]], "text string")
    patterns = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "pattern string, n int")
    found = substrings.substring_join(texts, patterns)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"x{n}y", n, i) for i, n in enumerate(names[:200]))
    assert met[0].count() < 200 * 150


def test_substring_join_is_exact(spark):
    texts = ["aaaaaaaaaaaa", "größe größe größe", "日本語日本語日本語", "ab", "a", "", None, "x/acme-works/y/acme-works", "éa"]
    patterns = ["a", "aa", "aaaaaaaaa", "größe", "größe größe", "日本語", "本語日本", "acme-works", "b", "", "nowhere at all", "é", None]
    expected = sorted((t, p) for t in texts if t for p in patterns if p and p in t)
    text_rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern_rows = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in (limit, "150", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            found = substrings.substring_join(text_rows, pattern_rows)
            assert found.columns == ["text", "pattern"]
            assert sorted(tuple(r) for r in found.collect()) == expected
        none = substrings.substring_join(text_rows, pattern_rows.filter("false"))
        assert none.columns == ["text", "pattern"] and none.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_keyword_table_cleans_a_role_once(spark, monkeypatch):
    read = []

    def substring_join(texts, patterns):
        read.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return substrings.substring_join(texts, patterns)

    monkeypatch.setattr(classify, "substring_join", substring_join)
    rows = with_clean_names(spark.createDataFrame([(1, "A", "QA &amp; lead"), (2, "B", None)], "ingest_pos int, company_name string, job_role string").repartition(2))
    table = spark.createDataFrame([("c", "C", 0, "both", "& lead")], "category_id string, category_name string, keyword_pos int, keyword string, term string")
    assert [r.ingest_pos for r in classify.keyword_match(rows, table).collect()] == [1]
    assert "Filter" not in read[0]


def test_split_compound_steps_are_columns(spark):
    lines = ["Veraxion - Data Engineer", "no", "USA - x y", None, "A &amp; B - &quot;Lead&quot;", "Acme - Clerk - Night", " - ", "É - Métier", "Acme Inc. Hires - Clerk"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string").repartition(2)
    both = labels.with_split_compound(df, F.col("line"), "steps").withColumn("once", labels.split_compound(F.col("line")))
    rows = both.orderBy("i").collect()
    assert [r.steps for r in rows] == [r.once for r in rows]
    assert [tuple(r.steps) if r.steps else None for r in rows][:2] == [("Veraxion", "Data Engineer"), None]
    assert rows[4].steps.company == "A & B" and rows[4].steps.role == "Lead"


def test_clean_segments_skip_the_cleaning(spark, apply):
    assert predicates.noise_sql("s").startswith("CASE WHEN s RLIKE")
    lines = ["Remote · Clerk • Full-time | Acme Labs", "  |Paris/ 2) Blue &amp; Co /x", "", None, "Clerk", "\u00a0Acme\u00a0|"]
    named = apply(lines, lambda c: labels.split_metadata(c, F.lit("Clerk")))
    assert named == ["Full", "Paris", None, None, None, "Acme"]


def test_feed_dates_are_read_at_once(spark):
    objects = ['{"posted_at":null,"created_at":"2024-01-01"}', '{"posted_on":[1],"created_at":"2024-01-01"}', '{"publish_date":1704067200.5}',
               '{"created_on":"soon"}', "7", '{"posted_date":"1704067200"}', '{"title":"x"}']
    bodies = spark.createDataFrame([(1, '{"objects":[' + ",".join(objects) + "]}")], "page_pos long, body string").repartition(2)
    rows = feeds.feed_b_postings(bodies, "2024-01-03 00:00:00").select("ingest_pos.at", "posted_date")
    assert [r.posted_date for r in rows.orderBy("at").collect()] == ["2 days ago", None, "2 days ago", None, None, "2 days ago", None]
    direct = bodies.select(F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$.objects", "array<variant>")).alias("at", "o"))
    direct = direct.select("at", feeds.first_source_date(F.col("o"), "2024-01-03 00:00:00").alias("d")).orderBy("at").collect()
    assert [r.d for r in direct] == [r.posted_date for r in rows.orderBy("at").collect()]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("variant_get(") < 8


def test_company_sizes_are_parsed_once_a_branch(spark):
    raw = spark.createDataFrame(
        [(1, "Acme", "N/A", "https://e.com/acme", "https://e.com/"), (2, "ACME", None, None, None), (3, "Beta", "12 staff", None, None)],
        "ingest_pos int, company_name string, employee_count_raw string, company_url string, page_url string",
    ).repartition(2)
    pages = spark.createDataFrame([(1, "https://e.com/acme", "Team size: 45")], "page_id int, url string, html string")
    sized = enrich.company_size_once(enrich.with_headcount(raw), pages)
    assert sorted((r.ingest_pos, r.number_of_people) for r in sized.collect()) == [(1, "45 employees"), (2, "45 employees"), (3, "12 employees")]
    filters_of = [line for line in sized._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("employee_count_raw" in line for line in filters_of)


def test_validity_cleans_names_in_columns(spark):
    rows = [("Acme", "Clerk", "N/A"), ("A &amp; B", "a b", "N/A"), ("Remote", "Clerk", "N/A"), (None, "Clerk", "N/A"), ("Acme", "acme", "N/A"), ("İi", "i̇i", "N/A"), ("Acme", "Clerk", "about 10")]
    df = spark.createDataFrame(rows, "company_name string, job_role string, number_of_people string").repartition(2)
    tested = filters.with_validity(df)
    names = [F.col(c) for c in df.columns]
    same = tested.withColumn("once", predicates.valid_names_and_size(*names)).collect()
    assert [r.is_valid for r in same] == [r.once for r in same]
    assert {r.company_name for r in same if r.is_valid and r.number_of_people == "N/A"} == {"Acme"}
    assert "_clean_company_name" in tested._jdf.queryExecution().optimizedPlan().toString()


def test_written_times_pass(spark, apply):
    values = ["2024-02-29 10:00:00", "2023-02-29 10:00:00", "0000-01-01 00:00:00", "2024-01-01 24:00:00", " 2024-01-01 00:00:00 ", "2024-01-01T00:00:00Z", "1704067200", "soon", "", None]
    assert apply(values, dates.normalize_published) == [
        "2024-02-29 10:00:00", "2023-02-29 10:00:00", "0000-01-01 00:00:00", "2024-01-01 24:00:00", "2024-01-01 00:00:00",
        "2024-01-01 00:00:00", "2024-01-01 00:00:00", "soon", None, None,
    ]
    shown = str(spark.range(1).select(dates.normalize_published(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString())
    assert "CASE WHEN (RLIKE" in shown.replace("rlike(", "RLIKE(")


def test_store_gate_reads_a_parsed_headcount(spark):
    """The gate's filter used to take the parser along, several times over, down to the scan."""
    raw = spark.createDataFrame([(1, "11 - 50"), (2, "N/A"), (3, None), (4, "over 200"), (5, "80 staff")], "i int, employee_count_raw string")
    fits = classify.eligible(enrich.with_headcount(raw.repartition(2)))
    assert sorted(r.i for r in fits.collect()) == [1, 2, 3, 5] and fits.columns == ["i", "employee_count_raw", "number_of_people"]
    filters_of = [line for line in fits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters_of and not any("employee_count_raw" in line for line in filters_of)


def test_size_tests_in_steps_agree(spark):
    sizes = ["11-50", "99", "100", "100+", "1,200", "1,0-2", "none of it", "N/A", " n/a ", "NULL", "none", "None", "Unknown", "", " ", None, "50 to 100", "5-", "99+ or 3", " 7 ", "-", "7" * 400]
    df = spark.createDataFrame([(v,) for v in sizes], "number_of_people string").repartition(2)
    people = F.col("number_of_people")
    rows = headcount.with_size_tests(df, "small", "unspecified").select(
        "*", headcount.size_under_100(people).alias("s"), headcount.size_unspecified(people).alias("u")
    ).collect()
    assert [(r.small, r.unspecified) for r in rows] == [(r.s, r.u) for r in rows] and len({(r.s, r.u) for r in rows}) == 3


def test_terms_inside_terms_need_no_test():
    assert rules.any_term_sql("r", ("qa", "QA lead", "a qa", "sdet", " sdet ")) == "(contains(r, 'qa') OR contains(r, 'sdet'))"
    assert rules.any_term_sql("r", ("", "x")) == "(contains(r, ''))"


def test_category_levels_read_the_same_hits(spark):
    """Both levels used to clean, parse and test every posting."""
    raw = spark.createDataFrame([(1, "A", "QA react", "10"), (2, "a", "qa REACT", "9"), (3, "B", "selenium qa", "N/A"), (4, "B", "clerk", "N/A"), (5, "C", None, "1"), (6, "C", "qa", "500")],
                                "ingest_pos int, company_name string, job_role string, employee_count_raw string")
    rows = classify.category_jobs(enrich.with_headcount(with_clean_names(raw.repartition(2))).drop("employee_count_raw"))
    kept = rows.filter("category_id = 'qa_automation'").select("ingest_pos", "keyword", "bucket").collect()
    under = [(i, k, b) for i in (1, 2) for k in ("QA & SDET",) for b in ("all", "under_100")] + [(3, k, b) for k in ("QA & SDET", "Selenium") for b in ("all", "unspecified")]
    whole = [(1, None, b) for b in ("all", "under_100")] + [(3, None, b) for b in ("all", "unspecified")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, under + whole))
    shown = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in shown and "contains(" not in shown.lower()


def test_numbered_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(50)], "g string, i long").repartition(4)
    placed = spread.with_position(df, ["i"], by=["g"])
    assert sorted((r.g or "", r.i, r.position) for r in placed.collect()) == [(g, i, i + 1) for g in ("", "a", "b") for i in range(50)]
    assert "BroadcastHashJoin" in plan(placed) and "SortMergeJoin" not in plan(placed)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again = spread.with_position(df, ["i"], by=["g"])
        assert "BroadcastHashJoin" not in plan(again)
        assert sorted((r.g or "", r.i, r.position) for r in again.collect()) == [(g, i, i + 1) for g in ("", "a", "b") for i in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_batches_number_narrow_rows(spark, monkeypatch):
    numbered = []

    def with_position(df, *args, **named):
        numbered.append(df.columns)
        return spread.with_position(df, *args, **named)

    monkeypatch.setattr(topk, "with_position", with_position)
    catalog.batch_100(spark, "/root/testdata/sf0.001")
    assert numbered == [["row_key", "date_tab", "ingest_pos"]]


def test_first_merge_leaves_the_store_partitioned(spark):
    """The store used to be joined with no rows, and shuffled once more for the next merge."""
    columns = "ingest_pos struct<a:int,b:string>, company_name string, job_role string, job_url string, number_of_people string, source_website string, posted_date string, published_at string, location string, posted_by string"
    old = [((1, "b"), "Acme", "Clerk", "https://e/1", "10", "x", None, None, "N/A", "Ann"), ((1, "a"), "ACME", "clerk", "https://e/1?b", "N/A", "y", "d", None, "Oslo", None)]
    new = [((2, "a"), "Acme", "Clerk", "https://e/1", "N/A", "z", None, "2024-01-01 00:00:00", "", "Bob"), (None, "Beta", "Clerk", None, "9", "z", None, None, None, None), ((3, "a"), "Beta", "Clerk", None, "7", "w", None, None, None, None)]
    batches = [spark.createDataFrame(rows, columns).repartition(3) for rows in (old, new)]

    def merged(empty):
        first = store.upsert_postings(batches[0], empty, "2024-01-02 00:00:00")[0]
        return store.upsert_postings(batches[1], first, "2024-01-03 00:00:00")[0]

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        known, unknown = merged(store.empty_store(spark)), merged(spark.createDataFrame([], schema.STORE))
        assert plan(known).count("Exchange hashpartitioning(fingerprint") == 2
        assert known.schema == unknown.schema
        rows = sorted(map(tuple, known.collect()))
        assert rows == sorted(map(tuple, unknown.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    acme = next(r for r in known.collect() if r.job_url)
    assert (acme.company_name, acme.job_role, acme.source_website, acme.number_of_people) == ("ACME", "clerk", "y", "10")
    assert (acme.location, acme.posted_by, acme.posted_date, acme.published_at, acme.scrape_count) == ("Oslo", "Bob", "d", "2024-01-01 00:00:00", 3)
    beta = next(r for r in known.collect() if not r.job_url)
    assert (beta.source_website, beta.number_of_people, beta.scrape_count) == ("w", "7", 2)


def test_text_is_joined_last(spark):
    """Rows with part and supplier names used to be shuffled for the join with orders."""
    shown = views.raw_postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    outer = [line for line in shown.splitlines() if "Join Inner" in line]
    assert ["s_suppkey" in outer[0], "p_partkey" in outer[1], "o_orderkey" in outer[2]] == [True] * 3
