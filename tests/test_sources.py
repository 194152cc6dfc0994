"""Feeds, page extraction, links and traversal."""

import json

import pytest
from pyspark.sql import functions as F

from jobsieve.plans.curation import curate
from jobsieve.sources import extract, feeds, links, markup

NOW = "2026-03-10 15:30:00"


def pages(spark, *rows):
    return spark.createDataFrame(
        [(i, url, html) for i, (url, html) in enumerate(rows)], "page_id bigint, url string, html string"
    )


CARD = """<article class="job-card"><h3 class="job-title"><a href="/jobs/{n}">{role}</a></h3>
<span class="company-name">{company}</span><div class="job-meta">{size}<span class="location">Austin, TX</span></div></article>"""


def board(next_link=True):
    cards = [
        CARD.format(n=1, role="Painter", company="Alpha Technologies", size='<span class="employee-count">45 employees</span>'),
        CARD.format(n=2, role="Data Clerk", company="Global Data Corp", size='<span class="employee-count">1.2K employees</span>'),
        CARD.format(n=3, role="Planner", company="Startup Ventures", size=""),
        CARD.format(n=1, role="Painter", company="Alpha Technologies", size=""),
    ]
    data = [{"@type": "JobPosting", "title": "Architect", "url": "https://e.com/jobs/9",
             "hiringOrganization": {"name": "Nova Systems", "numberOfEmployees": {"value": 450}}}]
    link = '<nav class="pagination"><a rel="next" href="/jobs?page=2">Next &raquo;</a></nav>' if next_link else ""
    return (
        f'<html><head><script type="application/ld+json">{json.dumps(data)}</script></head><body>'
        f'<h1>Open</h1><div class="job-listings">{"".join(cards)}</div>{link}</body></html>'
    )


def test_board_page_end_to_end(spark):
    df = pages(spark, ("https://e.com/jobs", board()))
    raw = extract.extract_tiered(df).orderBy("ingest_pos").collect()
    assert [(r.company_name, r.job_role, r.employee_count_raw, r.source_type) for r in raw] == [
        ("Nova Systems", "Architect", "450", "json_ld"),
        ("Alpha Technologies", "Painter", "45 employees", "dom_card"),
        ("Global Data Corp", "Data Clerk", "1.2K employees", "dom_card"),
        ("Startup Ventures", "Planner", None, "dom_card"),
        ("Alpha Technologies", "Painter", None, "dom_card"),
    ]
    assert raw[1].job_url == "https://e.com/jobs/1"
    kept = curate(extract.extract_tiered(df)).orderBy("ingest_pos").collect()
    assert [(r.company_name, r.number_of_people) for r in kept] == [
        ("Alpha Technologies", "45 employees"), ("Startup Ventures", "N/A"),
    ]
    assert links.next_page_link(df).first().next_url == "https://e.com/jobs?page=2"


def test_metadata_and_compound_cards(spark):
    html = (
        '<article class="card"><span class="cat">Moderation</span><h3><a href="/job/7">Reviewer - US</a></h3>'
        '<div class="meta">\n TELUS Digital · USA \n</div><p class="summary">Looking for work?</p></article>'
        '<article class="card"><div class="employer-job-name">Veraxion - Data Engineer</div>'
        '<h3>ignored</h3><a href="/go">open</a></article>'
    )
    rows = extract.extract_cards(pages(spark, ("https://e.com/", html))).orderBy("ingest_pos").collect()
    assert [(r.company_name, r.job_role, r.employee_count_raw, r.job_url) for r in rows] == [
        ("TELUS Digital", "Reviewer - US", None, "https://e.com/job/7"),
        ("Veraxion", "Data Engineer", None, "https://e.com/go"),
    ]


def test_hydration_is_found_at_any_depth_and_case(spark):
    deep = {"JobTitle": "Deep", "companyName": {"name": "Below Inc"}, "teamSize": 12}
    for _ in range(600):
        deep = {"x": [deep]}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(deep)}</script>'
    bad = '<script id="__NEXT_DATA__">{oops</script>'
    rows = extract.extract_hydration(pages(spark, ("u", html), ("v", bad))).collect()
    assert [(r.company_name, r.job_role, r.employee_count_raw) for r in rows] == [("Below Inc", "Deep", "12")]


def test_tables_only_when_nothing_else(spark):
    table = "<table><tr><th>Role</th><th>Company</th></tr><tr><td>Cook</td><td>Diner Inc</td></tr></table>"
    df = pages(spark, ("https://e.com/a", board() + table), ("https://e.com/b", f"<html>{table}</html>"))
    rows = extract.extract_tiered(df).filter("source_type = 'table'").collect()
    assert [(r.page_id, r.company_name) for r in rows] == [(1, "Diner Inc")]


def test_detail_pages_complete_invalid_rows(spark):
    detail = '<h1>Reviewer</h1><div class="topline"><strong>TELUS Digital</strong> · USA</div><i class="size">12 people</i>'
    raw = spark.createDataFrame(
        [(1, "Remote", "Reviewer x", "https://e.com/job/7?a=1", None, "https://e.com/", "N/A"),
         (2, "Good Corp", "Clerk", "https://e.com/job/7", None, "https://e.com/", "N/A"),
         (3, "Remote", "Clerk", "https://other.org/job/7", None, "https://e.com/", "N/A")],
        "ingest_pos bigint, company_name string, job_role string, job_url string, company_url string, "
        "page_url string, number_of_people string",
    )
    rows = extract.follow_detail(raw, pages(spark, ("https://e.com/job/7", detail))).orderBy("ingest_pos").collect()
    assert [(r.company_name, r.job_role, r.number_of_people) for r in rows] == [
        ("TELUS Digital", "Reviewer", "12 employees"), ("Good Corp", "Clerk", "N/A"), ("Remote", "Clerk", "N/A"),
    ]


def test_next_link_rules(spark):
    df = pages(
        spark,
        ("https://e.com/l?page=3&q=a b", '<ul class="pagination"><li>Next »</li></ul>'),
        ("https://e.com/a/", '<a href="#x">Next</a><a href="more">next page</a>'),
        ("https://e.com/b", '<a href="https://other.org/">Next</a><button disabled onclick="f()">Next</button>'),
        ("https://e.com/c", '<a aria-label="Go to next" href="../d/./e">more</a>'),
    )
    found = {r.page_id: r.next_url for r in links.next_page_link(df).collect()}
    assert found == {0: "https://e.com/l?page=4&q=a+b", 1: "https://e.com/a/more", 3: "https://e.com/d/e"}
    visited = spark.createDataFrame([("https://e.com/a/more",)], "url string")
    assert 1 not in {r.page_id for r in links.next_page_link(df, visited).collect()}


def test_traversal_stops(spark):
    def page(n, body):
        return (f"https://e.com/l?page={n}", f'{body}<a rel="next" href="?page={n + 1}">x</a>')

    table = "<table><tr><th>Role</th><th>Company</th></tr><tr><td>Cook</td><td>Diner Inc</td></tr></table>"
    df = pages(spark, *[page(n, table if n < 3 else "") for n in range(1, 12)])
    start = spark.createDataFrame([("https://e.com/l?page=1",)], "url string")
    visits = links.traverse_pages(df, start, max_pages=1000).orderBy("page_no").collect()
    assert [r.records for r in visits] == [1, 1, 0, 0, 0]
    assert links.traverse_pages(df, start, max_pages=2).count() == 2
    assert links.traverse_pages(df, start, max_pages=1000, max_records=1).count() == 1
    loop = pages(spark, ("https://e.com/x", '<a rel="next" href="/y">n</a>'), ("https://e.com/y", '<a rel="next" href="/x">n</a>'))
    begin = spark.createDataFrame([("https://e.com/x",)], "url string")
    assert links.traverse_pages(loop, begin, max_pages=1000).count() == 2


def test_relative_urls(spark):
    cases = [
        ("https://e.com/a/b?x=1", "c"), ("https://e.com", "c"), ("https://e.com/a/", "/r?q=1#f"),
        ("https://e.com/a", "//cdn.org/z"), ("https://e.com/a?x", "?y=2"), ("https://e.com/a/b/c", "../../d"),
        ("https://e.com/a", "mailto:x@y"), ("https://e.com/a", "#top"), ("https://e.com/a/b", ".."),
    ]
    from urllib.parse import urljoin

    df = spark.createDataFrame(cases, "base string, href string")
    got = [r.u for r in df.select(markup.resolve_url(F.col("base"), F.col("href")).alias("u")).collect()]
    assert got == [urljoin(b, h) for b, h in cases]


def test_feeds(spark):
    body_a = {"jobs": [
        {"title": "T", "companyName": "micro1", "companySlug": "micro1", "guid": "g", "applicationLink": "", "pubDate": 1773100800,
         "locationRestrictions": ["Spain", "Italy"]},
        {"title": "U", "companyName": "T2", "applicationLink": "l"},
    ]}
    raw = spark.createDataFrame([(0, json.dumps(body_a)), (1, "{bad")], "page_pos bigint, body string")
    rows = feeds.feed_a_postings(raw).orderBy("ingest_pos").collect()
    assert [(r.job_url, r.location, r.published_at) for r in rows] == [("g", "Spain, Italy", "1773100800"), ("l", "Remote", None)]

    objects = [
        {"title": "", "candidate_title": "Dev", "employer": {"company_name": "A", "employee_count": 10, "location": ["", "Rome"]},
         "posted_at": "soon", "created_at": "2026-03-10"},
        {"title": "Dev", "employer": None, "locations": [{"name": "Pune"}, {}, "", {"city": "", "name": "Goa"}], "created_on": 1773000000.5,
         "public_url": "https://e.com/job-77-x"},
        {"title": "Dev", "location": "n/a", "public_url": "https://e.com/dev-at-acme-lima/?q=1", "id": 5},
    ]
    raw = spark.createDataFrame([(0, json.dumps({"objects": objects}))], "page_pos bigint, body string")
    rows = feeds.feed_b_postings(raw, NOW).orderBy("ingest_pos").collect()
    assert [(r.job_role, r.employee_count_raw, r.location, r.posted_date, r.job_id) for r in rows] == [
        ("Dev", "10", "Rome", None, None),
        ("Dev", None, "Pune, Goa", "2 days ago", "77"),
        ("Dev", None, "Lima", None, "5"),
    ]


def page(spark, html, url="https://e.com/jobs"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


@pytest.mark.parametrize("depth", [1, 3, 6])
@pytest.mark.parametrize("graph", [False, True])
def test_jsonld_is_opened_to_any_depth(spark, depth, graph):
    body = '{"@type": "JobPosting", "title": "Clerk", "hiringOrganization": {"name": "Acme"}}'
    for _ in range(depth):
        body = f'{{"@graph": [{body}]}}' if graph else f"[{body}]"
    html = f'<script type="application/ld+json">{body}</script>'
    rows = extract.extract_jsonld(page(spark, html)).collect()
    assert [(r.company_name, r.job_role) for r in rows] == [("Acme", "Clerk")]


def test_bad_pages_do_not_fail_the_job(spark):
    deep = "[" * 200_000
    for html in ("<p>a</p><![foo[x]]><p>b</p>", f'<script id="__NEXT_DATA__">{deep}</script>',
                 f'<script type="application/ld+json">{deep}</script>'):
        assert extract.extract_tiered(page(spark, html)).count() == 0


def test_long_links_are_not_cut(spark):
    path = "/" + "x" * 150_000
    df = spark.createDataFrame([("https://e.com/a/b?q=1", path)], "base string, href string")
    out = df.select(markup.resolve_url(F.col("base"), F.col("href")).alias("u")).first().u
    assert out == "https://e.com" + path


def test_chains_that_share_a_page(spark, monkeypatch):
    """A third of the chains go through one page; those that end leave the loop."""
    html = [(f"https://e.com/l?page={n}", f'<a rel="next" href="{"hub" if n % 3 == 0 else f"end{n}"}">x</a>') for n in range(30)]
    html += [("https://e.com/hub", '<a rel="next" href="hub2">x</a>'), ("https://e.com/hub2", "")]
    df = pages(spark, *html)
    sizes = []
    advance = links._advance

    def counted(chains, *rest):
        sizes.append(chains.count())
        return advance(chains, *rest)

    monkeypatch.setattr(links, "_advance", counted)
    rows = links.traverse_pages(df, df.filter("page_id < 30").select("url"), max_pages=9).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.page_no):
        found.setdefault(r.start_url, []).append(r.url.rsplit("/", 1)[1])
    assert found == {u: [u.rsplit("/", 1)[1]] + (["hub", "hub2"] if n % 3 == 0 else []) for n, (u, _) in enumerate(html[:30])}
    assert sizes == [30, 30, 10]


def test_wanted_pages_without_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    df = pages(spark, *[(f"https://e.com/{n % 4}?x={n}", str(n)) for n in range(12)])
    keys = spark.createDataFrame([("https://e.com/1",), ("https://e.com/9",)], "_key string")
    try:
        for limit in (before, "-1"):
            spark.conf.set(name, limit)
            assert [(r.page_id, r._key) for r in extract.wanted_pages(df, keys).collect()] == [(1, "https://e.com/1")]
    finally:
        spark.conf.set(name, before)


def test_nested_json_ld(spark):
    item = {"@type": "JobPosting", "title": "Deep", "hiringOrganization": "Below Inc"}
    deep = item
    for n in range(300):
        deep = [deep] if n % 2 else {"@graph": [deep, {"@type": "Other"}]}
    script = '<script type="application/ld+json">{}</script>'
    df = pages(spark, ("https://e.com/a", script.format(json.dumps(deep)) + script.format("{oops")), ("https://e.com/b", script.format(json.dumps([item, [item]]))))
    for rows in (extract.extract_jsonld(df), extract.extract_tiered(df)):
        assert sorted((r.page_id, r.company_name, r.ingest_pos.at0, r.ingest_pos.at1) for r in rows.collect()) == [
            (0, "Below Inc", 0, 0), (1, "Below Inc", 0, 0), (1, "Below Inc", 0, 1)]
