"""Scalar functions on literal inputs."""

import html
import re

import pytest
from pyspark.sql import functions as F

from jobsieve.functions import dates, headcount, labels, predicates, text, urls

NOW = "2026-03-10 15:30:00"


def reference_clean(value):
    plain = html.unescape(value or "").replace("\xa0", " ")
    plain = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", plain)
    return re.sub(r"\s+", " ", plain).strip()


def test_clean_text_equals_the_plain_python_rules(apply):
    values = [
        "   Software    Engineer \n\t  ", "R&amp;D &lt;Lead&gt; &#39;Platform&#39;", None, "", "a\xa0 b",
        "&notit; &copy &#x80; &#0; &#xD800; &#99999999999; &foo; a&b &amp;amp;", "&", "&;", "\x01a\x0bb",
        "&#x110000; &#xfffe; &#1; &acE; &ThickSpace;x &hellip;&#128512;", "&ampx &nbsp;", "&apos;&quot;",
    ]
    assert apply(values, text.clean_text) == [reference_clean(v) for v in values]


def test_company_role_and_key(apply):
    assert apply(
        [' "ABC Technologies" ', " - Microsoft - ", "Amazon Web Services |", "1. Foo", "2) Bar"],
        text.clean_company,
    ) == ["ABC Technologies", "Microsoft", "Amazon Web Services", "Foo", "Bar"]
    assert apply(["  'Senior Backend Developer'  ", "Full Stack Engineer -"], text.clean_role) == [
        "Senior Backend Developer", "Full Stack Engineer",
    ]
    assert apply(["Microsoft, Inc.", "  microsoft inc  ", "日本"], text.normalize_key) == [
        "microsoftinc", "microsoftinc", "",
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("200 - 500 employees", "200 - 500 employees"),
        ("Founded in 2012 • 200 - 500 employees", "200 - 500 employees"),
        ("Founded in 2015 • More than 1000 employees", "More than 1000 employees"),
        ("1000+ staff", "More than 1000 employees"),
        ("Over 500 employees", "More than 500 employees"),
        ("10", "10 - 50 employees"), ("1", "1 - 10 employees"), ("50", "50 - 200 employees"),
        ("200", "200 - 500 employees"), ("500", "500 - 1000 employees"),
        ("1000", "More than 1000 employees"), ("250 employees", "250 employees"),
        ("1,250 employees", "1,250 employees"), ("1.2K employees", "1,200 employees"),
        ("10.7", "10 - 50 employees"), ("2.5", "2 employees"), ("3M people", "3,000,000 employees"),
        (",", "N/A"), (None, "N/A"), ("", "N/A"), ("   ", "N/A"), ("Unknown", "N/A"),
        ("Competitive Salary", "N/A"), ("Not specified", "N/A"), ("Full-time", "N/A"), ("Remote", "N/A"),
    ],
)
def test_parse_headcount(apply, raw, expected):
    assert apply([raw], headcount.parse_headcount) == [expected]


def test_size_predicates(apply):
    values = ["1,250 employees", "1 - 10 employees", "11-50", "99", "100", "5+", "N/A", None,
              "1,000 - 5,000", "50 to 100", "n/a", "50 - 200 employees"]
    assert apply(values, headcount.size_under_100) == [
        False, True, True, True, False, False, False, False, False, True, False, False,
    ]
    assert apply(["N/A", None, "Not Specified", "200"], headcount.size_eligible) == [
        True, True, True, False,
    ]
    assert apply(["501 - 1000", "1 - 10 employees", "250 employees"], headcount.size_bucket) == [
        ["Small (1-50)", "Large (500+)"], ["Small (1-50)"], [],
    ]


def test_locations_descriptions_and_names(apply):
    values = ["USA", "Worldwide", "Remote", "Europe, European timezones", "San Francisco, CA", "Acme, Co",
              "TELUS Digital", "Global Data Corp", "Worldwide Studios", "", "..."]
    assert apply(values, predicates.is_location) == [True] * 6 + [False] * 5
    long_text = "Looking for a freelance opportunity where you can make an impact. Join our community."
    assert apply([long_text, "role:x", "role: x", "Overview"], predicates.is_description) == [
        True, True, False, False,
    ]
    assert apply(["USA", "TELUS Digital", long_text, "apply", None, "A"], predicates.valid_company) == [
        False, True, False, False, False, False,
    ]
    assert apply(["* bullet", "Engineer", "Quick Apply", long_text], predicates.valid_role) == [
        False, True, False, False,
    ]
    assert apply(["Neuro team", "May day", "Full-time", "Acme Works", ""], predicates.is_noise) == [
        True, True, True, False, True,
    ]
    assert apply(
        ["250", "0", "N/A", "-5", "approx 50", "Unknown", "1,200,000 employees", "5,000+",
         "more than 10 employees", "1 - 10 employees", None],
        predicates.valid_headcount,
    ) == [True, True, True, False, False, False, False, False, True, True, False]


def test_urls(apply):
    assert apply(
        ["http://EX.com/a/b/?x=1", "http://h/", "https://e.com/jobs/1#top", "http://h/a;p/b;q"],
        urls.normalize_url,
    ) == ["http://ex.com/a/b", "http://h", "https://e.com/jobs/1", "http://h/a;p/b"]
    cities = ["https://x/job-12-dev-at-acme-pune/?a=1", "https://x/dev-new-delhi", "https://x/dev-at-acme-co-oslo",
              "https://x/y"]
    assert apply(cities, urls.city_of_url) == ["Pune", "New Delhi", "Oslo", None]
    params = apply(
        ["https://h.app/jobs?page=4", "https://h.app/jobs/data-engineer?offset=40", "https://h.app/jobs/api"],
        urls.feed_window_params,
    )
    assert [tuple(p) for p in params] == [
        (60, 3, None, 1), (40, 0, "data engineer", 3), (0, 0, None, 1),
    ]
    scope = lambda c: urls.in_scope(c, F.lit("https://example.com"))
    assert apply(["http://a.example.com/x", "http://badexample.com", "http://example.com"], scope) == [
        True, False, True,
    ]


def test_dates(apply):
    iso = ["2026-03-09T23:59:00Z", "2026-03-10T01:00:00+05:00", "1773100800", "1773100800000", "bad", None, ""]
    assert apply(iso, lambda c: dates.source_age_label(c, NOW)) == [
        "Yesterday", "Yesterday", "Today", "Today", None, None, None,
    ]
    offsets = [1, 3, 4, 11, 40, 70]
    stamps = [f"{d}" for d in offsets]
    fine = lambda c: dates.age_label_fine(
        F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(c.cast("int"), F.lit(1)), NOW
    )
    assert apply(stamps, fine) == [
        "1 day ago", "3 days ago", "4 days ago", "11 days ago", "1 month ago", "2 months ago",
    ]
    assert apply(["2026-03-10 02:00:00+05:30", "1773100800000", " soon ", ""], dates.normalize_published) == [
        "2026-03-09 20:30:00", "2026-03-10 00:00:00", "soon", None,
    ]


def test_dates_do_not_depend_on_the_session_zone(spark, apply):
    values = ["2026-03-08T07:30:00Z", "1773100800"]
    before = apply(values, dates.normalize_published)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(values, dates.normalize_published) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels(apply):
    halves = apply(["Veraxion - Data Engineer", "no", "USA - x y"], labels.split_compound)
    assert [h and tuple(h) for h in halves] == [("Veraxion", "Data Engineer"), None, None]
    metadata = lambda c: labels.split_metadata(c, F.lit("Copywriter"))
    assert apply(
        ["Coalition Technologies • Worldwide • Full-time • $50,000/yr", "USA · TELUS Digital", "USA"], metadata
    ) == ["Coalition Technologies", "TELUS Digital", None]


def test_a_megabyte_of_place_words_is_a_location(apply):
    assert apply(["remote " * 150_000, "Remote, India", "remote x " * 1000], predicates.is_location) == [True, True, False]
