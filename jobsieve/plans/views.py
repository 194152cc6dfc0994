"""Postings derived from the given tables.

The column expressions are plain SQL text that Spark and DuckDB both read, so
the queries and their SQL counterparts run on the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobsieve.functions.urls import company_slug
from jobsieve.operators.dedupe import with_clean_names
from jobsieve.operators.enrich import with_headcount

AS_OF = "2001-11-05 12:00:00"
STORED_AT = "2001-11-04 06:00:00"
EVENTS_AS_OF = "2024-01-31 12:00:00"

SLUG = "replace(lower(s_name), '#', '-')"
ROW_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

RAW = {
    "row_key": ROW_KEY,
    "company_name": """CASE WHEN l_partkey % 50 = 0 THEN 'Remote' WHEN l_partkey % 50 = 1 THEN 'Apply now'
        WHEN l_linenumber % 4 = 1 THEN ' "' || s_name || '" '
        WHEN l_linenumber % 4 = 2 THEN '2) ' || s_name || ' |'
        WHEN l_linenumber % 4 = 3 THEN s_name || '  &amp;  Co' ELSE s_name END""",
    "job_role": """CASE WHEN l_partkey % 60 = 7 THEN 'We are hiring ' || p_name
        WHEN l_partkey % 60 = 8 THEN s_name ELSE p_name || CASE p_partkey % 10
        WHEN 0 THEN ' QA engineer' WHEN 1 THEN ' DevOps lead' WHEN 2 THEN ' React developer'
        WHEN 3 THEN ' - Python backend developer' WHEN 4 THEN ' data engineer'
        WHEN 5 THEN ' product designer' WHEN 6 THEN ' Solutions Engineer'
        WHEN 7 THEN ' software engineer' WHEN 8 THEN ' Selenium testing' ELSE '' END END""",
    "employee_count_raw": """CASE l_partkey % 9 WHEN 0 THEN '11 - 50 employees' WHEN 1 THEN '1000+ staff'
        WHEN 2 THEN '250 employees' WHEN 3 THEN '1.2K employees' WHEN 4 THEN 'N/A' WHEN 6 THEN '10'
        WHEN 7 THEN 'Team size: 45' WHEN 8 THEN '1' ELSE NULL END""",
    "slug": SLUG,
    "job_url": f"""CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 'https://jobs.example.com/companies/'
        || {SLUG} || '/jobs/' || CAST(l_partkey AS string) || '?utm=' || CAST(l_linenumber AS string) END""",
    "company_url": f"'https://jobs.example.com/company/' || {SLUG}",
    "page_url": "'https://jobs.example.com/list?page=' || CAST(l_orderkey AS string)",
    "source_website": """CASE l_suppkey % 3 WHEN 0 THEN 'himalayas.app' WHEN 1 THEN 'instahyre.com'
        ELSE 'https://jobs.example.com/' END""",
    "published_at": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS string) END",
    "posted_date": """CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE '3 days ago' END""",
    "location": """CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N/A'
        ELSE 'NATION_' || CAST(s_nationkey AS string) END""",
    "posted_by": """CASE o_custkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN ' Clerk ' || CAST(o_custkey AS string)
        ELSE NULL END""",
    "first_seen_at": "l_shipdate",
    "is_new": "l_returnflag = 'N'",
    "stored": "l_linestatus = 'F'",
}
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
RAW_FROM = (
    "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN orders ON l_orderkey = o_orderkey"
)

# one profile per supplier; every fourth supplier has none
PROFILE = {
    "company_slug": SLUG,
    "company_name": "s_name",
    "employee_count": """CASE s_suppkey % 5 WHEN 0 THEN '11-50' WHEN 1 THEN '' WHEN 2 THEN 'N/A'
        WHEN 3 THEN '500 employees' ELSE '1 - 10 employees' END""",
    "updated_at": "TIMESTAMP '2001-01-01 00:00:00'",
    "profile_pos": "s_suppkey",
}

APPLICATION = {
    "name": "'  ' || c_name || ' '",
    "contact": "'id' || CAST(o_orderkey AS string)",
    "linkedin_url": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'https://in.example.com/' || CAST(c_custkey AS string) END",
    "job_role": """CASE o_orderkey % 8 WHEN 0 THEN ' Software Engineer' WHEN 1 THEN 'React developer'
        WHEN 2 THEN 'Sales Director' WHEN 3 THEN 'QA lead' WHEN 4 THEN 'DevOps' WHEN 5 THEN 'ML engineer'
        WHEN 6 THEN 'Curiosity officer' ELSE 'Clerk' END""",
    "company_name": "CASE WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END",
    "job_url": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'https://jobs.example.com/' || CAST(o_orderkey AS string) END",
    "current_salary": "CAST(NULL AS string)",
    "expected_salary": "o_orderpriority",
    "notice_period": "'30 days'",
    "resume_filename": "CASE WHEN o_custkey % 2 = 0 THEN 'cv.pdf' ELSE NULL END",
    "applied_at": "o_orderdate",
}


# tables that drive a query; the others are looked up
_DRIVING = ("lineitem", "orders", "part", "documents", "pages", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table.

    A driving table stored as fewer file splits than there are cores is spread
    by its first column, or one task would do all the work.  A large table has
    more splits than cores and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _DRIVING and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, df.columns[0])
    return df


def _select(df: DataFrame, columns: dict[str, str], *more) -> DataFrame:
    # TIMESTAMP literals and casts are read as TIMESTAMP_NTZ, as DuckDB reads them
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()], *more)


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as raw postings with a unique arrival position.

    The tables that bring text are joined last, so that large joins shuffle numbers only.
    """
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    return _select(joined, RAW, F.struct(*ARRIVAL).alias("ingest_pos"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings with cleaned names and a parsed headcount."""
    return with_headcount(with_clean_names(raw_postings(spark, sf_dir)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 3")
    columns = {**PROFILE, "updated_at": "TIMESTAMP_NTZ '2001-01-01 00:00:00'"}
    return _select(suppliers, columns)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")
    )
    return _select(joined, APPLICATION)


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings with the company slug column that feed operators expect."""
    rows = raw_postings(spark, sf_dir)
    return rows.withColumn("company_slug", company_slug(F.col("slug")))


# ---------------------------------------------------------------------------
# Feed responses: one response per order, one entry per lineitem
# ---------------------------------------------------------------------------
FEED_A_JOB = {
    "title": "p_name",
    "companyName": "s_name",
    "companySlug": SLUG,
    "guid": "'https://guid.example.com/' || CAST(l_partkey AS string)",
    "applicationLink": """CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'https://apply.example.com/'
        || CAST(l_partkey AS string) END""",
    "pubDate": "900000000 + l_partkey * 60",
}


def feed_a_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    job = F.struct(
        *[F.expr(e).alias(n) for n, e in FEED_A_JOB.items()],
        F.expr(
            "CASE l_linenumber % 3 WHEN 0 THEN array() WHEN 1 THEN array('Spain') "
            "ELSE array('Spain', 'Italy') END"
        ).alias("locationRestrictions"),
        F.expr("array('Full-Stack')").alias("categories"),
        F.expr("CASE WHEN p_size > 25 THEN array('Developer') ELSE array('Sales') END").alias(
            "parentCategories"
        ),
    )
    entry = F.struct(F.struct(*ARRIVAL).alias("at"), job.alias("job"))
    pages = joined.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    jobs = F.transform("e", lambda x: x["job"])
    body = F.to_json(F.struct(F.size("e").alias("totalCount"), jobs.alias("jobs")))
    return pages.select(F.col("l_orderkey").alias("page_pos"), body.alias("body"))


FEED_B_URL = """'https://www.example.com/job-' || CAST(l_partkey AS string) || '-dev-at-acme' ||
        CASE l_linenumber WHEN 5 THEN '-new-delhi/?x=1' WHEN 6 THEN '-corp-lima' ELSE '' END"""
FEED_B_OBJECT = {
    "place": """CASE l_linenumber WHEN 1 THEN '"locations":["Pune"," Delhi ",""],'
        WHEN 2 THEN '"location":" Oslo ",' WHEN 3 THEN '"locations":[],"job_locations":[{"city":"Kochi"},{"name":"Indore"}],'
        WHEN 7 THEN '"city":"N/A",' ELSE '' END""",
    "employer_place": "CASE l_linenumber WHEN 4 THEN ',\"location\":\"Rome\"' ELSE '' END",
    "dated": """CASE l_partkey % 5 WHEN 0 THEN '"posted_at":"2001-11-04T10:00:00Z",'
        WHEN 1 THEN '"posted_on":null,"published_on":1004500000000,' WHEN 2 THEN '"created_at":"soon",'
        WHEN 3 THEN '"publish_date":"1003000000","created_at":"2001-11-05",' ELSE '' END""",
    "ident": "CASE WHEN l_suppkey % 2 = 0 THEN '\"id\":' || CAST(l_partkey AS string) || ',' ELSE '' END",
    "heading": "CASE WHEN l_suppkey % 3 = 0 THEN '\"candidate_title\"' ELSE '\"title\"' END",
    "people": "CASE l_suppkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '\"500\"' WHEN 2 THEN 'null' ELSE '7' END",
}


def feed_b_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    parts = {n: F.expr(e) for n, e in FEED_B_OBJECT.items()}
    obj = F.concat(
        F.lit("{"), parts["place"], parts["dated"], parts["ident"], parts["heading"],
        F.lit(':"'), F.col("p_name"), F.lit('","public_url":"'), F.expr(FEED_B_URL),
        F.lit('","employer":{"company_name":"'), F.col("s_name"),
        F.lit('","employee_count":'), parts["people"], parts["employer_place"], F.lit("}}"),
    )
    entry = F.struct(F.struct(*ARRIVAL).alias("at"), obj.alias("o"))
    pages = joined.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    listed = F.array_join(F.transform("e", lambda x: x["o"]), ",")
    return pages.select(
        F.col("l_orderkey").alias("page_pos"),
        F.concat(F.lit('{"meta":{"total_count":9},"objects":['), listed, F.lit("]}")).alias("body"),
    )


# ---------------------------------------------------------------------------
# Stored job pages: one page per part
# ---------------------------------------------------------------------------
SITE = "https://board.example.com"
PART_URL = f"'{SITE}/jobs/' || CAST(p_partkey AS string)"
PART_COMPANY = "replace(p_brand, '#', ' ') || ' Works'"

JSON_LD = """'<html><head><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"' || p_name
    || '","hiringOrganization":{"name":"' || replace(p_brand, '#', ' ') || ' Works","sameAs":"https://b.example.com",'
    || '"numberOfEmployees":{"value":' || CAST(p_size AS string) || '}},"url":"https://board.example.com/p/'
    || CAST(p_partkey AS string) || '"},{"@type":"Event","title":"no"}]}</script>'
    || '<script type="application/ld+json">[{"@type":["Thing","JobPosting"],"name":"second ' || p_name
    || '","hiringOrganization":"Solo ' || p_type || '"}]</script><script type="application/ld+json">{bad</script>'
    || '</head><body><h1>x</h1></body></html>'"""
HYDRATION = """'<html><body><script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"jobTitle":"'
    || p_name || '","companyName":{"name":"' || replace(p_brand, '#', ' ') || ' Works"},"teamSize":' || CAST(p_size AS string)
    || ',"more":{"title":"inner ' || p_name || '","company":"In ' || p_type || '"}},{"title":"no company"}]}}</script></body></html>'"""
CARDS = """'<html><body><div class="list"><article class="job-card"><h3 class="job-title"><a href="/job/'
    || CAST(p_partkey AS string) || '"> ' || p_name || ' </a></h3><span class="company-name">' || replace(p_brand, '#', ' ')
    || ' Works</span><div><span class="employee-count">' || CAST(p_size AS string)
    || ' employees</span><span class="location">Remote</span></div></article>'
    || '<article class="job-card"><h3>Second ' || p_name || '</h3><div class="meta">USA &middot; ' || p_type
    || ' Labs &middot; Full-time</div><p>about ' || CAST(p_size AS string) || ' employees here</p>'
    || '<a href="../go/' || CAST(p_partkey AS string) || '?a=1">open</a></article></div>'
    || '<nav class="pagination"><a href="/list?page=0">Previous</a><a rel="next" href="/list?page='
    || CAST(p_partkey AS string) || '">Next &raquo;</a></nav></body></html>'"""
TABLES = """'<html><body><table><tr><th>Job Title</th><th>Company</th><th>Team size</th></tr><tr><td> ' || p_name
    || ' </td><td>' || replace(p_brand, '#', ' ') || ' Works</td><td>' || CAST(p_size AS string) || '</td></tr>'
    || '<tr><td></td><td>none</td></tr><tr><td>Other ' || p_name || '</td><td>' || p_type
    || ' Labs</td></tr></table><table><tr><td>a</td></tr></table></body></html>'"""
DETAIL = """'<html><body><h1>' || p_name || '</h1><div class="topline"><strong>' || replace(p_brand, '#', ' ')
    || ' Works</strong> &middot; USA</div><div class="team-size">' || CAST(p_size AS string)
    || ' people</div></body></html>'"""


def part_pages(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    """One page per part, its HTML built by the given expression."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").cast("long").alias("page_id"),
        F.expr(PART_URL).alias("url"),
        F.expr(html).alias("html"),
    )


MIXED = f"""CASE p_partkey % 5 WHEN 0 THEN {JSON_LD} WHEN 1 THEN {HYDRATION} WHEN 2 THEN {CARDS}
    WHEN 3 THEN {TABLES} ELSE {CARDS} || {TABLES} END"""

# the given pages, with two job cards at the end of each body
STORED_CARDS = """'<div><article class="job-card"><h3><a href="/job/' || CAST(page_id AS string) || '">Painter ' || CAST(page_id AS string)
    || '</a></h3><span class="company-name">Firm ' || CAST(page_id AS string) || ' Works</span><span class="team-size">'
    || CAST(page_id % 90 + 2 AS string) || ' people</span></article><article class="job-card"><h3>Welder</h3><div class="meta">Union '
    || CAST(page_id AS string) || ' Labs &middot; Full-time</div></article></div>'"""


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = F.concat(F.expr(STORED_CARDS), F.lit("</body>"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("</body>"), embedded).alias("html"))


# chains of ten list pages; every page links to the following one
CHAIN_URL = "'https://board.example.com/list?page=' || CAST(p_partkey AS string)"
CHAIN = """CASE WHEN p_partkey % 10 = 9 THEN '<html><body><p>end</p></body></html>'
    ELSE '<html><body><table><tr><th>role</th><th>company</th></tr><tr><td>' || p_name || '</td><td>' || p_type
    || ' Labs</td></tr></table><a aria-label="Next page" href="?page=' || CAST(p_partkey + 1 AS string)
    || '">more</a></body></html>' END"""


def chain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pages(spark, sf_dir, CHAIN).withColumn(
        "url", F.concat(F.lit(f"{SITE}/list?page="), F.col("page_id").cast("string"))
    )
