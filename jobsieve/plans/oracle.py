"""DuckDB SQL for the queries of the catalog, written independently of the operators.

RE2 has no look-around and only ASCII word boundaries, so boundaries are spelled
out as neighbouring characters.
"""

from __future__ import annotations

from jobsieve import fixed
from jobsieve.plans import views

AS_OF = f"TIMESTAMP '{views.AS_OF}'"
STORED_AT = f"TIMESTAMP '{views.STORED_AT}'"
EVENTS_AS_OF = f"TIMESTAMP '{views.EVENTS_AS_OF}'"
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOWORD = r"[^\p{L}\p{N}_]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


# --- scalar rules --------------------------------------------------------------


def clean_text(x: str) -> str:
    x = f"coalesce({x}, '')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def clean_label(x: str) -> str:
    return (
        rf"trim(regexp_replace({clean_text(x)}, '^\d+[.)]\s+', ''), {q(fixed.EDGE_PUNCTUATION)})"
    )


def key(x: str) -> str:
    return f"regexp_replace(lower({clean_text(x)}), '[^a-z0-9]', '', 'g')"


def has(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {q(pattern)}{', ' + q(flags) if flags else ''})"


def is_location(clean: str) -> str:
    low = f"lower({clean})"
    affix = f"(^|[^a-z])({'|'.join(fixed.COMPANY_AFFIXES)})([^a-z]|$)"
    words = "|".join(fixed.LOCATION_WORDS)
    only = f"^[^a-z]*({words})([^a-z]+({words}))*[^a-z]*$"
    city = r"^[A-Z\s]+,\s*[A-Z]{2}$"
    return (
        f"({low} IN ({names(fixed.KNOWN_LOCATIONS)}) OR (NOT {has(low, affix)} AND "
        f"({has(low, only)} OR ({has(low, '[a-z]')} AND {has(f'upper({low})', city)}))))"
    )


def is_noise(clean: str) -> str:
    words = f"len(string_split({clean}, ' '))"
    dated = has(clean, f"(^|{NOWORD})({fixed.DATE_WORDS})({NOWORD}|$)", "i")
    pay = f"({has(clean, fixed.SALARY_MARKS, 'i')} OR " + has(
        clean, f"(^|{NOWORD})({fixed.SALARY_WORDS})({NOWORD}|$)", "i"
    ) + ")"
    kind = has(clean, f"(^|{NOWORD})({fixed.JOB_TYPE_WORDS})({NOWORD}|$)", "i")
    return (
        f"({clean} = '' OR {is_location(clean)} OR (({dated} OR {pay}) AND {words} <= 5) "
        f"OR ({kind} AND {words} <= 4))"
    )


def is_description(clean: str) -> str:
    starters = fixed.DESCRIPTION_STARTERS.split("|")
    plain = "|".join(s for s in starters if not s.endswith(":"))
    colon = "|".join(s for s in starters if s.endswith(":"))
    return (
        f"({has(clean, f'^({plain})({NOWORD}|$)', 'i')} OR {has(clean, f'^({colon}){WORD}', 'i')} "
        rf"OR {has(clean, r'\.\s+[A-Z]')} OR length({clean}) > 120)"
    )


def valid_company(x: str) -> str:
    c = clean_label(x)
    return (
        f"coalesce(trim({x}) <> '' AND length({c}) BETWEEN 2 AND 80 AND lower({c}) NOT IN "
        f"({names(fixed.UI_ACTIONS)}) AND NOT {is_location(c)} AND NOT {is_description(c)}, false)"
    )


def valid_role(x: str) -> str:
    c = clean_label(x)
    bullet = r"^\s*[-•*]\s+"
    return (
        f"coalesce(trim({x}) <> '' AND length({c}) BETWEEN 2 AND 120 AND lower({c}) NOT IN "
        f"({names(fixed.UI_ACTIONS)}) AND NOT {is_description(c)} AND NOT "
        f"{has(c, bullet)}, false)"
    )


def valid_headcount(x: str) -> str:
    n = r"[0-9]+(?:,[0-9]+)?"
    hedged = has(f"trim({x})", f"(^|{NOWORD})({fixed.HEDGES})({NOWORD}|$)", "i")
    first = has(f"trim({x})", rf"^{n}(?:\s*[-–—]\s*{n})?\s*(?:employees)?$", "i")
    second = has(f"trim({x})", rf"^more than\s*{n}\s*employees$", "i")
    return f"coalesce(trim({x}) = 'N/A' OR (NOT {hedged} AND ({first} OR {second})), false)"


def unspecified(x: str) -> str:
    return f"coalesce(lower(trim({x})) IN ({names(fixed.SIZE_UNSPECIFIED)}), true)"


def under_100(x: str) -> str:
    t = f"replace(lower(trim({x})), ',', '')"
    pair = r"([0-9]+)\s*[-–—to]+\s*([0-9]+)"
    high = f"TRY_CAST(regexp_extract({t}, '{pair}', 2) AS DOUBLE)"
    one = f"TRY_CAST(regexp_extract({t}, '([0-9]+)', 1) AS DOUBLE)"
    return (
        f"coalesce(CASE WHEN trim({x}) IN ({names(fixed.SIZE_NOT_SMALL)}) THEN false "
        rf"WHEN {high} IS NOT NULL THEN {high} <= 100 WHEN {has(t, r'[0-9]\+')} THEN false "
        f"ELSE {one} < 100 END, false)"
    )


def eligible(x: str) -> str:
    return f"({unspecified(x)} OR {under_100(x)})"


def tier(n: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in fixed.HEADCOUNT_TIERS.items())
    return f"CASE {n} {cases} END"


def suffix_number(x: str) -> str:
    plain = f"replace(trim({x}), ',', '')"
    unit = f"lower(regexp_extract({plain}, '([kmbKMB])$', 1))"
    amount = rf"TRY_CAST(regexp_replace({plain}, '\s*[kmbKMB]$', '') AS DOUBLE)"
    factor = f"CASE {unit} WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END"
    return f"CAST(round_even({amount} * {factor}, 0) AS BIGINT)"


def sized(source: str, column: str = "employee_count_raw", out: str = "number_of_people") -> str:
    """A subquery that adds the parsed headcount to every row of a source."""
    e = lambda pattern, g: f"nullif(regexp_extract(_x, {q('(?i)' + pattern)}, {g}), '')"
    count = lambda n: f"coalesce({tier(n)}, format('{{:,}}', {n}) || ' employees')"
    return f"""(SELECT * EXCLUDE (_x, _more, _low, _high, _n1, _n2, _n3, _exact), CASE
      WHEN _x IS NULL OR _x = '' THEN 'N/A'
      WHEN {tier('_exact')} IS NOT NULL THEN {tier('_exact')}
      WHEN _more IS NOT NULL THEN 'More than ' || _more || ' employees'
      WHEN _low IS NOT NULL THEN _low || ' - ' || _high || ' employees'
      WHEN _n1 IS NOT NULL THEN {count('_n1')} WHEN _n2 IS NOT NULL THEN {count('_n2')}
      WHEN _n3 IS NOT NULL THEN {count('_n3')} ELSE 'N/A' END AS {out}
    FROM (SELECT *, CAST(floor(TRY_CAST(_x AS DOUBLE)) AS BIGINT) AS _exact,
      coalesce({e(fixed.MORE_THAN_PATTERN, 1)}, {e(fixed.MORE_THAN_PATTERN, 2)}) AS _more,
      {e(fixed.RANGE_PATTERN, 1)} AS _low, {e(fixed.RANGE_PATTERN, 2)} AS _high,
      {suffix_number(e(fixed.LABEL_BEFORE_PATTERN, 1))} AS _n1,
      {suffix_number(e(fixed.LABEL_AFTER_PATTERN, 1))} AS _n2,
      {suffix_number(e(fixed.PURE_NUMBER_PATTERN, 1))} AS _n3
      FROM (SELECT *, trim({column}) AS _x FROM {source})))"""


def url_key(x: str) -> str:
    cut = f"regexp_replace({x}, '[?#].*$', '')"
    return f"lower(rtrim(regexp_replace({cut}, ';[^/]*$', ''), '/'))"


def dedupe_key(company: str, role: str, url: str) -> str:
    return f"coalesce(nullif({url_key(url)}, ''), {key(company)} || '::' || {key(role)})"


def fingerprint(company: str, role: str, url: str) -> str:
    return (
        f"sha256(lower(trim({company})) || '||' || lower(trim({role})) || CASE WHEN {url} <> '' "
        f"THEN '||' || lower(rtrim(split_part({url}, '?', 1), '/')) ELSE '' END)"
    )


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def url_slug(x: str) -> str:
    return f"nullif(trim(lower(regexp_extract({x}, '/companies/([^/]+)', 1))), '')"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def month_day(x: str) -> str:
    return f"strftime({x}, '%b') || ' ' || CAST(day({x}) AS VARCHAR)"


def days(ts: str, at: str) -> str:
    return f"date_diff('day', CAST({ts} AS DATE), CAST({at} AS DATE))"


def calendar_age(ts: str, at: str) -> str:
    d = f"greatest(0, {days(ts, at)})"
    return (
        f"CASE WHEN {ts} IS NULL THEN 'Unknown' WHEN {d} = 0 THEN 'Today' WHEN {d} = 1 THEN 'Yesterday' "
        f"WHEN {d} <= 6 THEN {d} || ' days ago' WHEN {d} <= 13 THEN '1 week ago' "
        f"WHEN {d} <= 20 THEN '2 weeks ago' WHEN {d} <= 27 THEN '3 weeks ago' "
        f"WHEN {d} <= 60 THEN '1 month ago' ELSE ({d} // 30) || ' months ago' END"
    )


def seconds(ts: str, at: str) -> str:
    return f"((epoch_us({at}) - epoch_us({ts})) / 1000000.0)"


def fine_age(ts: str, at: str) -> str:
    d, h = days(ts, at), f"CAST(floor({seconds(ts, at)} / 3600) AS BIGINT)"
    return (
        f"CASE WHEN {ts} IS NULL THEN 'Unknown' WHEN {d} = 0 AND {h} < 1 THEN 'Today' "
        f"WHEN {d} = 0 AND {h} = 1 THEN '1 hour ago' WHEN {d} = 0 THEN {h} || ' hours ago' "
        f"WHEN {d} = 1 THEN '1 day ago' WHEN {d} < 30 THEN {d} || ' days ago' "
        f"WHEN {d} < 60 THEN '1 month ago' ELSE ({d} // 30) || ' months ago' END"
    )


def role_category(x: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(trim({x})), {q(t)})' for t in terms)} THEN {q(name)}"
        for name, terms in fixed.ROLE_CATEGORIES
    )
    return f"CASE {cases} ELSE 'Other' END"


# --- derived tables --------------------------------------------------------------

_ARRIVAL = ", ".join(views.ARRIVAL)


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


RAW = (
    f"raw AS (SELECT {_columns(views.RAW)}, row_number() OVER (ORDER BY {_ARRIVAL}) AS pos, "
    f"l_orderkey, l_partkey, l_suppkey FROM {views.RAW_FROM})"
)
CLEAN = (
    f"cleaned AS (SELECT * REPLACE ({clean_label('company_name')} AS company_name, "
    f"{clean_label('job_role')} AS job_role) FROM raw)"
)
POSTINGS = f"WITH {RAW}, {CLEAN}, postings AS (SELECT * FROM {sized('cleaned')}) "
ONLY_RAW = f"WITH {RAW} "
PROFILES = f"profiles AS (SELECT {_columns(views.PROFILE)} FROM supplier WHERE s_suppkey % 4 <> 3)"
KNOWN = "known AS (SELECT company_slug, employee_count FROM profiles WHERE employee_count <> '')"
APPS = (
    f"WITH a0 AS (SELECT {_columns(views.APPLICATION)} FROM orders JOIN customer "
    f"ON o_custkey = c_custkey), apps AS (SELECT *, {role_category('job_role')} AS role_category "
    "FROM a0) "
)


def with_more(*ctes: str) -> str:
    return POSTINGS + "".join(f", {c}" for c in ctes) + " "


KEYWORDS = [
    (cid, cname, pos, kw, terms)
    for cid, cname, kws in fixed.CATEGORY_KEYWORDS
    for pos, (kw, terms) in enumerate(kws)
]
RULES = "rules(category_id, category_name, keyword_pos, keyword) AS (VALUES " + ", ".join(
    f"({q(c)}, {q(n)}, {p}, {q(k)})" for c, n, p, k, _ in KEYWORDS
) + ")"
TERMS = "terms(category_id, keyword_pos, term) AS (VALUES " + ", ".join(
    f"({q(c)}, {p}, {q(t.strip().lower())})" for c, _, p, _, ts in KEYWORDS for t in ts
) + ")"


def matches(source: str) -> str:
    """Posting and keyword pairs of a source."""
    return (
        f"roles AS (SELECT DISTINCT job_role FROM {source}), hits AS (SELECT DISTINCT job_role, "
        "category_id, keyword_pos FROM roles JOIN terms ON contains(lower(job_role), term)), "
        f"matched AS (SELECT s.*, h.category_id, r.category_name, h.keyword_pos, r.keyword FROM {source} s "
        "JOIN hits h USING (job_role) JOIN rules r ON r.category_id = h.category_id "
        "AND r.keyword_pos = h.keyword_pos)"
    )


ELIGIBLE = f"fit AS (SELECT * FROM postings WHERE {eligible('number_of_people')})"
DISTINCT = (
    "per_category AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_id, "
    "lower(company_name), lower(job_role) ORDER BY keyword_pos, pos) AS rn FROM matched) WHERE rn = 1)"
)
OVERVIEW = f"""counts AS (
  SELECT category_id, keyword_pos, count(*) AS total, count(*) FILTER ({under_100('number_of_people')}) AS small
  FROM matched GROUP BY ALL
  UNION ALL SELECT category_id, -1, count(*), count(*) FILTER ({under_100('number_of_people')})
  FROM per_category GROUP BY category_id),
every AS (SELECT * FROM rules UNION ALL SELECT DISTINCT category_id, category_name, -1, '(all)' FROM rules),
overview AS (SELECT e.category_id, e.category_name, e.keyword_pos, e.keyword,
  coalesce(total, 0) AS total_jobs, coalesce(small, 0) AS under_100_jobs
  FROM every e LEFT JOIN counts c ON e.category_id = c.category_id AND e.keyword_pos = c.keyword_pos)"""


def bucket_test(x: str, name: str) -> str:
    tests = [f"contains({x}, {q(t)})" for t in fixed.SIZE_BUCKETS[name]]
    if name.startswith("Large"):
        tests.append(f"contains(lower({x}), 'more than')")
    return "(" + " OR ".join(tests) + ")"


_DEDUPE = dedupe_key("company_name", "job_role", "job_url")
FIRST = (
    f"first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_DEDUPE} ORDER BY pos) AS arrival "
    "FROM postings) WHERE arrival = 1)"
)
VALID = (
    f"{valid_company('company_name')} AND {valid_role('job_role')} AND {key('company_name')} <> "
    f"{key('job_role')} AND {valid_headcount('number_of_people')}"
)
CURATED = (
    f"curated AS (SELECT * FROM first WHERE {eligible('number_of_people')} AND {VALID})"
)


def enriched(source: str) -> str:
    """The source with its headcount filled from the profiles."""
    need = "coalesce(trim(number_of_people) IN ('N/A', '', 'None'), true)"
    return (
        f"enriched AS (SELECT s.* REPLACE (CASE WHEN {need} THEN coalesce(u.employee_count, "
        f"n.employee_count, nullif(number_of_people, ''), 'N/A') ELSE number_of_people END AS number_of_people) "
        f"FROM {source} s LEFT JOIN known u ON u.company_slug = {url_slug('job_url')} "
        f"LEFT JOIN known n ON n.company_slug = {slug('company_name')})"
    )


_FP = fingerprint("company_name", "job_role", "job_url")


def fold(rows: str, order: str) -> str:
    """Sequential upsert of rows (with fp, run_at = time of the run) in the given order."""
    def good(name: str, value: str) -> str:
        return f"arg_max({value}, {order}) FILTER ({value} <> 'N/A' AND {value} <> '')"

    def last(name: str) -> str:
        return f"arg_max({name}, {order}) FILTER ({name} IS NOT NULL)"

    def text(name: str) -> str:
        return f"coalesce(nullif(trim({name}), ''), 'N/A')"

    return f"""SELECT fp AS fingerprint, {last('job_url')} AS job_url,
      arg_min(company_name, {order}) AS company_name, arg_min(job_role, {order}) AS job_role,
      coalesce({good('', 'number_of_people')}, arg_min(number_of_people, {order})) AS number_of_people,
      arg_min(source_website, {order}) AS source_website,
      {stamp('min(run_at)')} AS first_seen_at, {stamp('max(run_at)')} AS last_seen_at,
      count(*) AS scrape_count, {last('posted_date')} AS posted_date,
      {last('published_at')} AS published_at,
      coalesce({good('', text('location'))}, 'N/A') AS location,
      coalesce({good('', text('posted_by'))}, 'N/A') AS posted_by
      FROM {rows} GROUP BY fp"""


RUNS = (
    f"runs AS (SELECT *, {_FP} AS fp, CASE WHEN stored THEN {STORED_AT} ELSE {AS_OF} END AS run_at, "
    "CASE WHEN stored THEN 0 ELSE 1000000000000 END + pos AS seq FROM postings)"
)

# publication texts of the catalog, and what they mean
_PUB_SECONDS = "(o_orderkey * 3600 + 900000000)"
PUBLISHED = f"""CASE o_orderkey % 5 WHEN 0 THEN CAST({_PUB_SECONDS} AS VARCHAR)
  WHEN 1 THEN CAST({_PUB_SECONDS} * 1000 AS VARCHAR) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T23:30:00-02:00'
  WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE 'soon ' || CAST(o_orderkey AS VARCHAR) END"""
PUBLISHED_TS = f"""CASE o_orderkey % 5 WHEN 0 THEN make_timestamp({_PUB_SECONDS} * 1000000)
  WHEN 1 THEN make_timestamp({_PUB_SECONDS} * 1000000)
  WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 90 MINUTE
  WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END"""

_FEED_FROM = (
    "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
)
_AT = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ARRIVAL}) - 1"
_PART_COMPANY = "replace(p_brand, '#', ' ') || ' Works'"
_PART_PAGE = views.PART_URL


def _tier_rows(kind: str, where: str = "true") -> str:
    """Expected raw rows of the page kinds built in the views."""
    page = f"p_partkey AS page_id, {_PART_PAGE} AS page_url"
    none = "CAST(NULL AS VARCHAR)"
    size = "CAST(p_size AS VARCHAR)"
    forms = {
        "json_ld": [
            ("p_name", _PART_COMPANY, size,
             "'https://board.example.com/p/' || CAST(p_partkey AS VARCHAR)", "'https://b.example.com'"),
            ("'second ' || p_name", "'Solo ' || p_type", none, _PART_PAGE, none),
        ],
        "hydration": [
            ("p_name", _PART_COMPANY, size, none, none),
            ("'inner ' || p_name", "'In ' || p_type", none, none, none),
        ],
        "dom_card": [
            ("p_name", _PART_COMPANY, f"{size} || ' employees'",
             "'https://board.example.com/job/' || CAST(p_partkey AS VARCHAR)", none),
            ("'Second ' || p_name", "p_type || ' Labs'", f"'about ' || {size} || ' employees here'",
             "'https://board.example.com/go/' || CAST(p_partkey AS VARCHAR) || '?a=1'", none),
        ],
        "table": [
            ("p_name", _PART_COMPANY, size, none, none),
            ("'Other ' || p_name", "p_type || ' Labs'", none, none, none),
        ],
        "detail_page": [("p_name", _PART_COMPANY, f"{size} || ' people'", _PART_PAGE, none)],
    }
    return " UNION ALL ".join(
        f"SELECT {page}, {role} AS job_role, {company} AS company_name, {people} AS employee_count_raw, "
        f"{url} AS job_url, {company_url} AS company_url, {q(kind)} AS source_type FROM part WHERE {where}"
        for role, company, people, url, company_url in forms[kind]
    )


_TIERED = " UNION ALL ".join(
    [
        _tier_rows("json_ld", "p_partkey % 5 = 0"),
        _tier_rows("hydration", "p_partkey % 5 = 1"),
        _tier_rows("dom_card", "p_partkey % 5 IN (2, 4)"),
        _tier_rows("table", "p_partkey % 5 = 3"),
    ]
)


def oracle_queries() -> dict[str, str]:
    sql: dict[str, str] = {}

    def over(source: str, name: str, **columns: str) -> None:
        prefix = ONLY_RAW if source == "raw" else POSTINGS
        sql[name] = f"{prefix}SELECT row_key, {_columns(columns)} FROM {source}"

    def table(source: str, name: str, ident: str, **columns: str) -> None:
        sql[name] = f"SELECT {ident}, {_columns(columns)} FROM {source}"

    # stored rows
    sql["upsert_postings"] = with_more(RUNS) + fold("runs", "seq")
    sql["upsert_delta"] = with_more(RUNS) + (
        f"SELECT fp AS fingerprint, NOT bool_or(stored) AS is_new, {stamp('min(run_at)')} AS first_seen_at, "
        "count(*) FILTER (NOT stored) AS batch_rows FROM runs GROUP BY fp HAVING bool_or(NOT stored)"
    )
    sql["new_vs_existing"] = with_more(RUNS) + (
        "SELECT row_key, fp AS fingerprint, fp NOT IN (SELECT fp FROM runs WHERE stored) AND "
        "pos = min(pos) OVER (PARTITION BY fp) AS is_new FROM runs WHERE NOT stored"
    )
    sql["write_snapshot"] = with_more(RUNS) + fold("(SELECT * FROM runs WHERE stored)", "seq")
    sql["align_schema"] = POSTINGS + (
        f"SELECT {_FP} AS fingerprint, job_url, company_name, job_role, number_of_people, source_website, "
        f"{stamp('first_seen_at')} AS first_seen_at, {stamp('first_seen_at')} AS last_seen_at, "
        "CAST(1 AS BIGINT) AS scrape_count, CAST(NULL AS VARCHAR) AS posted_date, "
        f"{stamp('make_timestamp((l_orderkey * 3600 + 900000000) * 1000000)')} AS published_at, "
        "CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS posted_by FROM postings"
    )
    sql["scan_postings"] = POSTINGS + (
        "SELECT row_key, company_name, source_website FROM postings "
        "WHERE source_website ILIKE '%jobs.%.com%'"
    )
    sql["scan_profiles"] = f"WITH {PROFILES}, {KNOWN} SELECT * FROM known"
    sql["lookup_profile"] = (
        f"WITH {PROFILES}, {KNOWN} SELECT * FROM known WHERE company_slug = 'supplier-000000005'"
    )
    fill = enriched("postings")
    sql["enrich_headcount"] = with_more(PROFILES, KNOWN, fill) + (
        "SELECT row_key, number_of_people FROM enriched"
    )
    published = "TRY_CAST(published_at AS TIMESTAMP)"
    label = (
        f"CASE WHEN published_at <> '' THEN {fine_age(published, AS_OF)} WHEN posted_date NOT IN "
        f"('Unknown', 'N/A', '') THEN posted_date ELSE {fine_age('first_seen_at', AS_OF)} END"
    )
    sql["master_postings"] = with_more(PROFILES, KNOWN, fill) + (
        f"SELECT row_key, company_name, job_role, number_of_people, {label} AS posted_date, "
        "coalesce(nullif(location, ''), 'N/A') AS location, coalesce(nullif(posted_by, ''), 'N/A') AS posted_by, "
        f"CAST(first_seen_at AS DATE) = CAST({AS_OF} AS DATE) AS is_new_today FROM enriched "
        "WHERE source_website ILIKE '%himalayas%'"
    )
    sql["attach_company_size"] = f"WITH {RAW}, {PROFILES}, {KNOWN} " + (
        f"SELECT row_key, {slug('slug')} AS company_slug, coalesce(employee_count, 'N/A') AS number_of_people "
        f"FROM raw LEFT JOIN known ON company_slug = {slug('slug')}"
    )
    sql["missing_profiles"] = f"WITH {RAW}, {PROFILES}, {KNOWN} " + (
        f"SELECT DISTINCT {slug('slug')} AS company_slug FROM raw WHERE {slug('slug')} NOT IN "
        "(SELECT company_slug FROM known)"
    )
    sql["unsized_companies"] = POSTINGS + (
        "SELECT company_name, count(*) AS postings, coalesce("
        f"{url_slug('min(job_url)')}, {slug('company_name')}) AS company_slug FROM postings WHERE "
        "source_website = 'himalayas.app' AND (number_of_people = 'N/A' OR number_of_people IS NULL) "
        "GROUP BY company_name ORDER BY postings DESC, company_name LIMIT 150"
    )
    sql["upsert_profiles"] = f"WITH {RAW}, {PROFILES}, rows_in AS (SELECT * FROM {sized('raw')}), " + (
        f"fresh AS (SELECT {slug('slug')} AS company_slug, arg_max(number_of_people, pos) AS c, "
        "arg_max(company_name, pos) FILTER (stored) AS n FROM rows_in GROUP BY 1) "
        "SELECT coalesce(f.company_slug, p.company_slug) AS company_slug, coalesce(n, company_name) AS company_name, "
        "CASE WHEN f.company_slug IS NOT NULL THEN c ELSE employee_count END AS employee_count, "
        f"{stamp(f'CASE WHEN f.company_slug IS NOT NULL THEN {AS_OF} ELSE updated_at END')} AS updated_at "
        "FROM profiles p FULL JOIN fresh f ON p.company_slug = f.company_slug"
    )
    sql["backfill_headcount"] = with_more(
        PROFILES,
        "usable AS (SELECT * FROM profiles WHERE employee_count <> 'N/A')",
        "urls AS (SELECT job_url, max(profile_pos) AS p FROM (SELECT DISTINCT job_url FROM postings) "
        "JOIN usable ON contains(lower(job_url), company_slug) GROUP BY job_url)",
        "by_name AS (SELECT company_name, max(profile_pos) AS p FROM usable GROUP BY company_name)",
    ) + (
        "SELECT row_key, CASE WHEN source_website = 'himalayas.app' THEN coalesce(s.employee_count, "
        "number_of_people) ELSE number_of_people END AS number_of_people FROM postings "
        "LEFT JOIN urls u USING (job_url) LEFT JOIN by_name n USING (company_name) "
        "LEFT JOIN usable s ON s.profile_pos = greatest(u.p, n.p)"
    )
    sql["backfill_published"] = with_more(
        "feed AS (SELECT *, l_orderkey * 3600 + 900000000 AS secs FROM postings WHERE NOT stored AND job_url <> '')",
        "fu AS (SELECT job_url, max(pos) AS p FROM feed GROUP BY ALL)",
        "fn AS (SELECT company_name, job_role, max(pos) AS p FROM feed GROUP BY ALL)",
        "joined AS (SELECT s.row_key, s.published_at, s.posted_date, make_timestamp(f.secs * 1000000) AS t "
        "FROM postings s LEFT JOIN fu USING (job_url) LEFT JOIN fn ON fn.company_name = s.company_name "
        "AND fn.job_role = s.job_role LEFT JOIN feed f ON f.pos = greatest(fu.p, fn.p) WHERE s.stored)",
    ) + (
        f"SELECT row_key, coalesce({stamp('t')}, published_at) AS published_at, CASE WHEN t IS NULL "
        f"THEN posted_date ELSE {fine_age('t', AS_OF)} END AS posted_date FROM joined"
    )

    # run, dedupe, validation
    sql["dedupe_postings"] = with_more(FIRST) + (
        "SELECT row_key, company_name, job_role, job_url, number_of_people FROM first"
    )
    sql["duplicates_count"] = POSTINGS + (
        f"SELECT count(*) - count(DISTINCT {_DEDUPE}) AS duplicates_removed FROM postings"
    )
    sql["valid_record"] = POSTINGS + (
        f"SELECT row_key, company_name, job_role, number_of_people FROM postings WHERE {VALID}"
    )
    flags = (
        f"flags AS (SELECT *, row_number() OVER (PARTITION BY {_DEDUPE} ORDER BY pos) > 1 AS dup, "
        f"{eligible('number_of_people')} AS fits, {VALID} AS ok FROM postings)"
    )
    sql["run_stats"] = with_more(flags) + (
        "SELECT count(DISTINCT page_url) AS pages_processed, count(*) AS jobs_discovered, "
        "count(*) FILTER (NOT dup AND fits AND ok) AS jobs_processed, "
        f"count(DISTINCT {key('company_name')}) FILTER (NOT dup AND fits AND ok) AS companies_discovered, "
        "count(*) FILTER (dup) AS duplicates_removed, "
        "count(*) FILTER (NOT dup AND fits AND trim(number_of_people) IN ('N/A', 'Unknown', '', 'None')) "
        "AS missing_employee_counts, "
        "count(*) FILTER (NOT dup AND fits AND ok AND is_new) AS new_jobs_added, "
        "count(*) FILTER (NOT dup AND fits AND ok AND NOT is_new) AS existing_jobs_seen FROM flags"
    )
    sql["curated_postings"] = with_more(FIRST, CURATED) + (
        "SELECT row_key, company_name, job_role, number_of_people FROM curated"
    )
    sql["curated_overview"] = with_more(
        FIRST, CURATED, PROFILES, KNOWN, enriched("curated"),
        f"fit AS (SELECT * FROM enriched WHERE {eligible('number_of_people')})",
        RULES, TERMS, matches("fit"), DISTINCT, OVERVIEW,
    ) + "SELECT * FROM overview"

    # scalar functions over the postings
    over("raw", "clean_company", value=clean_label("company_name"))
    over("raw", "clean_role", value=clean_label("job_role"))
    over("raw", "valid_company", value=valid_company("company_name"))
    over("raw", "valid_role", value=valid_role("job_role"))
    sql["parse_headcount"] = f"{POSTINGS}SELECT row_key, number_of_people AS value FROM postings"
    over("postings", "valid_headcount", value=valid_headcount("number_of_people"))
    over("postings", "size_unspecified", value=unspecified("employee_count_raw"))
    over(
        "postings", "size_under_100",
        value=under_100("number_of_people"), raw_value=under_100("employee_count_raw"),
    )
    buckets = ", ".join(
        f"CASE WHEN {bucket_test('number_of_people', n)} THEN {q(n)} END" for n in fixed.SIZE_BUCKETS
    )
    over("postings", "size_bucket", value=f"concat_ws('|', {buckets})")
    over("postings", "fingerprint", value=_FP)
    over("postings", "company_slug", value=slug("company_name"))
    over("postings", "slug_from_url", value=url_slug("job_url"))
    over("postings", "age_label", value=calendar_age("first_seen_at", AS_OF))
    over("postings", "age_label_iso", value=calendar_age(published, AS_OF))
    over("postings", "posted_label", value=label)
    over("postings", "is_new_today", value=f"CAST(first_seen_at AS DATE) = CAST({AS_OF} AS DATE)")
    over("postings", "date_tab", value=f"coalesce({month_day('first_seen_at')}, 'Other')")
    over("postings", "classify_role", value=role_category("job_role"))
    who = "nullif(trim(coalesce(posted_by, '')), '')"
    rest = "concat_ws(', ', nullif(location, 'N/A'), nullif(company_name, ''))"
    over(
        "postings", "posted_by_label",
        value=f"CASE WHEN {who} IS NULL THEN 'N/A' WHEN {rest} <> '' THEN {who} || ' (' || {rest} || ')' ELSE {who} END",
    )
    header = clean_text("company_name || ' - ' || job_role")
    sql["split_compound"] = POSTINGS + (
        f", halves AS (SELECT row_key, {header} AS h FROM postings), cut AS (SELECT row_key, "
        f"{clean_label(chr(39) * 2 + ' || split_part(h, ' + q(' - ') + ', 1)')} AS c, "
        f"{clean_label('substr(h, length(split_part(h, ' + q(' - ') + ', 1)) + 4)')} AS r FROM halves) "
        f"SELECT row_key, CASE WHEN {valid_company('c')} AND {valid_role('r')} THEN c END AS company, "
        f"CASE WHEN {valid_company('c')} AND {valid_role('r')} THEN r END AS role FROM cut"
    )
    line = "'Remote · ' || job_role || ' • Full-time | ' || company_name"
    seg = clean_label("s")
    sql["split_metadata"] = POSTINGS + (
        f", lines AS (SELECT row_key, pos, job_role, unnest(regexp_split_to_array({line}, {q(fixed.METADATA_DELIMITERS)})) AS s, "
        f"generate_subscripts(regexp_split_to_array({line}, {q(fixed.METADATA_DELIMITERS)}), 1) AS i FROM postings), "
        f"named AS (SELECT row_key, pos, job_role, i, {seg} AS s FROM lines WHERE trim(s) <> ''), "
        f"ok AS (SELECT pos, arg_min(s, i) AS value FROM named WHERE NOT {is_noise('s')} AND "
        f"{valid_company('s')} AND s <> job_role GROUP BY pos) "
        "SELECT row_key, value FROM postings LEFT JOIN ok USING (pos)"
    )
    own, other = host("job_url"), host("source_website")
    over(
        "postings", "in_scope",
        own=f"coalesce({own}, '') = 'example.com' OR ends_with(coalesce({own}, ''), '.example.com')",
        other=f"coalesce({own}, '') = {other} OR ends_with(coalesce({own}, ''), '.' || {other})",
    )
    sql["size_eligible"] = POSTINGS + (
        f"SELECT row_key, number_of_people FROM postings WHERE {eligible('number_of_people')}"
    )

    # scalar functions over other tables
    def digest(expr: str) -> dict[str, str]:
        return {"digest": f"md5({expr})", "length": f"CAST(length({expr}) AS INTEGER)"}

    table("documents", "clean_text", "doc_id", **digest(clean_text("text")))
    table("pages", "clean_text_html", "page_id", **digest(clean_text("html")))
    table("documents", "normalize_key", "doc_id", **digest(key("text")))
    table("documents", "is_description", "doc_id", value=is_description(clean_text("text")))
    pieces = (
        "WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.,\n]')) AS piece FROM documents), "
        f"c AS (SELECT doc_id, {clean_text('piece')} AS a, {clean_text(chr(39) + 'Remote, ' + chr(39) + ' || substr(piece, 1, 8)')} AS b FROM pieces) "
    )
    for name, test in (("is_location", is_location), ("is_noise", is_noise)):
        sql[name] = pieces + (
            f"SELECT doc_id, count(*) AS pieces, count(*) FILTER ({test('a')}) AS plain_hits, "
            f"count(*) FILTER ({test('b')}) AS place_hits FROM c GROUP BY doc_id"
        )
    table("pages", "normalize_url", "page_id", value=url_key("url"))
    table("pages", "domain_of", "page_id", value=rf"regexp_replace({host('url')}, '^www\.', '')")
    n = "CAST(page_id AS VARCHAR)"
    own_page = "TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS BIGINT)"
    page_no = f"greatest(1, CASE page_id % 4 WHEN 3 THEN {own_page} ELSE page_id END)"
    offset = f"CASE WHEN page_id % 4 = 1 THEN page_id WHEN page_id % 4 = 3 AND {own_page} IS NULL THEN 0 ELSE ({page_no} - 1) * 20 END"
    keyword = "CASE page_id % 4 WHEN 1 THEN 'data engineer' WHEN 2 THEN 'a b c' END"
    table(
        "pages", "feed_window_params", "page_id",
        offset=offset,
        page=f"CASE WHEN page_id % 4 = 1 OR (page_id % 4 = 3 AND {own_page} IS NULL) THEN 0 ELSE {page_no} - 1 END",
        keyword=keyword,
        search_page=f"CASE WHEN {keyword} <> '' AND {offset} > 0 THEN {offset} // 20 + 1 ELSE 1 END",
    )
    sql["feed_b_filters"] = f"""
      SELECT page_id, 'skill' AS param, 'java,a b' AS value FROM pages UNION ALL
      SELECT page_id, 'page', {n} FROM pages UNION ALL
      SELECT page_id, 'industry_type', '7' FROM pages WHERE page_id % 2 = 0 UNION ALL
      SELECT page_id, 'industry_types', '13' FROM pages WHERE page_id % 2 = 1 UNION ALL
      SELECT page_id, 'company_size', CASE WHEN page_id % 2 = 0 THEN '3' ELSE '0' END FROM pages UNION ALL
      SELECT page_id, 'job_type', CASE WHEN page_id % 2 = 0 THEN '0' ELSE '4' END FROM pages UNION ALL
      SELECT page_id, 'isLandingPage', 'true' FROM pages UNION ALL
      SELECT page_id, 'limit', '20' FROM pages"""
    # a query or fragment in the page URL hides the appended job path from the slug
    table(
        "pages", "city_from_url", "page_id",
        city="CASE WHEN contains(url, '?') THEN NULL ELSE CASE page_id % 6 WHEN 0 THEN 'Pune' "
        "WHEN 1 THEN 'New Delhi' WHEN 2 THEN 'Greater Noida' WHEN 3 THEN 'Lima' WHEN 4 THEN 'Oslo' END END",
    )
    table(
        "orders", "job_id_from_url", "o_orderkey",
        job_id="CASE WHEN o_custkey % 2 = 0 AND o_custkey <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END",
    )
    table(
        "orders", "format_count", "o_orderkey",
        value="CASE WHEN o_orderstatus = 'P' THEN '0' ELSE format('{:,}', o_orderkey * 1237) END",
        people="CASE o_orderstatus WHEN 'F' THEN format('{:,}', o_custkey * 100) WHEN 'O' THEN o_orderpriority ELSE 'N/A' END",
    )
    titled = "'a/b:[c]*?' || text"
    table(
        "documents", "safe_tab_title", "doc_id",
        title=rf"substr(trim(regexp_replace({titled}, '[\\/*?:\[\]]', '_', 'g')), 1, 31)",
        category_title=rf"substr(regexp_replace(translate({titled}, '/\:', '---'), '[?*\[\]]', '', 'g'), 1, 31)",
    )
    number = "(o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END)"
    table(
        "orders", "parse_numeric_suffix", "o_orderkey",
        value=f"CASE o_orderkey % 5 WHEN 0 THEN CAST({number} * 1000 AS BIGINT) WHEN 1 THEN CAST({number} * 1000000 AS BIGINT) "
        f"WHEN 2 THEN CAST(round_even({number}, 0) AS BIGINT) WHEN 3 THEN CAST({number} * 1000000000 AS BIGINT) END",
    )
    table(
        "orders", "profile_size_from_text", "o_orderkey",
        value="CASE WHEN o_custkey % 3 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) || '-500' END",
    )
    table(
        "orders", "normalize_published", "o_orderkey",
        value=f"coalesce({stamp(PUBLISHED_TS)}, {PUBLISHED})",
    )
    sql["source_age_label"] = (
        f"WITH t AS (SELECT o_orderkey, {PUBLISHED_TS} AS ts FROM orders) SELECT o_orderkey, "
        f"CASE WHEN ts IS NOT NULL THEN {calendar_age('ts', AS_OF)} END AS value FROM t"
    )
    table("events", "age_label_fine", "event_id", value=fine_age("ts", EVENTS_AS_OF))
    gap = f"CAST(floor({seconds('ts', EVENTS_AS_OF)} / 60) AS BIGINT)"
    table(
        "events", "age_label_ui", "event_id",
        value=f"CASE WHEN {gap} < 1 THEN 'Just now' WHEN {gap} < 60 THEN {gap} || 'm ago' "
        f"WHEN {gap} // 60 < 24 THEN ({gap} // 60) || 'h ago' WHEN {gap} // 1440 = 1 THEN 'Yesterday' "
        f"WHEN {gap} // 1440 < 7 THEN ({gap} // 1440) || 'd ago' ELSE {month_day('ts')} END",
    )
    table("orders", "extraction_age", "o_orderkey", value="'Today'")

    # filters
    sql["source_filter"] = POSTINGS + (
        "SELECT row_key, source_website FROM postings WHERE source_website ILIKE '%instahyre%'"
    )
    sql["engineering_filter"] = (
        f"SELECT l_orderkey AS page_pos, p_name AS job_role, s_name AS company_name FROM {_FEED_FROM} "
        "WHERE p_size > 25 OR l_orderkey % 2 = 0"
    )
    sql["search_preview"] = POSTINGS + (
        "SELECT row_key, company_name, job_role FROM postings WHERE is_new AND number_of_people = "
        "'1 - 10 employees' AND (company_name ILIKE '%devops%' OR job_role ILIKE '%devops%')"
    )
    sql["search_stream"] = POSTINGS + (
        "SELECT row_key, number_of_people FROM postings WHERE company_name ILIKE '%more than%' OR "
        "job_role ILIKE '%more than%' OR number_of_people ILIKE '%more than%'"
    )
    sql["search_feed"] = POSTINGS + (
        f"SELECT row_key, {role_category('job_role')} AS role_category FROM postings WHERE "
        f"{role_category('job_role')} = 'Frontend' AND (job_role ILIKE '%ring%' OR company_name ILIKE '%ring%')"
    )
    sql["new_only"] = POSTINGS + "SELECT row_key, is_new FROM postings WHERE is_new"
    sql["new_only_fallback"] = POSTINGS + "SELECT row_key, is_new FROM postings WHERE NOT is_new"

    # classification and metrics
    sql["keyword_match"] = with_more(RULES, TERMS, matches("postings")) + (
        "SELECT row_key, category_id, keyword_pos, keyword FROM matched"
    )
    sql["keyword_match_table"] = sql["keyword_match"] + (
        " UNION ALL SELECT row_key, 'nations' AS category_id, n_nationkey AS keyword_pos, n_name AS keyword FROM postings "
        "JOIN nation ON contains(lower(job_role), lower(substr(n_name, 1, 2)))"
    )
    sql["distinct_in_category"] = with_more(RULES, TERMS, matches("postings"), DISTINCT) + (
        "SELECT row_key, category_id, keyword, company_name, job_role FROM per_category"
    )
    size = f"CASE WHEN {under_100('number_of_people')} THEN 'under_100' ELSE 'unspecified' END"
    both = (
        "both_levels AS (SELECT row_key, category_id, keyword, number_of_people FROM matched UNION ALL "
        "SELECT row_key, category_id, NULL, number_of_people FROM per_category)"
    )
    chain = (ELIGIBLE, RULES, TERMS, matches("fit"), DISTINCT)
    sql["category_jobs"] = with_more(*chain, both) + (
        "SELECT row_key, category_id, keyword, 'all' AS bucket, number_of_people FROM both_levels UNION ALL "
        f"SELECT row_key, category_id, keyword, {size}, number_of_people FROM both_levels"
    )
    sql["category_overview"] = with_more(*chain, OVERVIEW) + "SELECT * FROM overview"
    sql["category_summary"] = with_more(*chain, OVERVIEW) + (
        "SELECT keyword_pos * 2 + 2 AS line, CASE WHEN keyword_pos = -1 THEN 'Total Jobs in Category' "
        "ELSE keyword || ' (Total)' END AS metric, total_jobs AS value FROM overview WHERE category_id = 'qa_automation' "
        "UNION ALL SELECT keyword_pos * 2 + 3, CASE WHEN keyword_pos = -1 THEN 'Jobs with <100 Employees' "
        "ELSE keyword || ' (<100 People)' END, under_100_jobs FROM overview WHERE category_id = 'qa_automation'"
    )
    sql["store_stats"] = POSTINGS + (
        "SELECT count(*) AS total_jobs, count(*) FILTER (CAST(first_seen_at AS DATE) = DATE '2001-11-04') AS new_today, "
        "count(DISTINCT company_name) AS total_companies, "
        "count(*) FILTER (source_website ILIKE '%instahyre%') AS feed_b_jobs, "
        "count(*) FILTER (source_website ILIKE '%himalayas%') AS feed_a_jobs, "
        "count(*) FILTER (source_website NOT ILIKE '%himalayas%' AND source_website NOT ILIKE '%instahyre%') AS other_jobs "
        "FROM postings"
    )
    sql["applications_stats"] = APPS + (
        "SELECT role_category, count(*) AS applications FROM apps GROUP BY role_category UNION ALL "
        "SELECT NULL, count(*) FROM apps"
    )
    sql["applications_summary"] = APPS + (
        f"SELECT role_category, count(*) AS applications, {stamp('max(applied_at)')} AS last_applied_at "
        "FROM apps GROUP BY role_category UNION ALL SELECT 'TOTAL', count(*), NULL FROM apps"
    )
    small, medium, large = (bucket_test("number_of_people", n) for n in fixed.SIZE_BUCKETS)
    lines = [
        ("Source URL", "'Master Database Archive'"),
        ("Extraction Date (UTC)", q(views.AS_OF)),
        ("Total Jobs Extracted", "count(*)"),
        ("New Jobs Added Today", "count(*) FILTER (is_new)"),
        ("Existing Jobs Retained", "count(*) FILTER (NOT is_new)"),
        ("Small Companies (1-50 employees)", f"count(*) FILTER ({small})"),
        ("Medium Companies (50-500 employees)", f"count(*) FILTER ({medium})"),
        ("Large Companies (500+ employees)", f"count(*) FILTER ({large})"),
        ("Unique Companies Found", "count(DISTINCT lower(company_name))"),
        ("Employee Counts Missing (N/A)", "count(*) FILTER (trim(number_of_people) IN ('N/A', 'Unknown', '', 'None'))"),
        ("Pages Processed", "0"),
    ]
    sql["master_summary"] = POSTINGS + " UNION ALL ".join(
        f"SELECT {i} AS line, {q(k)} AS metric, CAST({v} AS VARCHAR) AS value FROM postings"
        if "count" in v
        else f"SELECT {i} AS line, {q(k)} AS metric, CAST({v} AS VARCHAR) AS value"
        for i, (k, v) in enumerate(lines, 1)
    )
    sql["master_companies"] = POSTINGS + (
        "SELECT count(DISTINCT lower(company_name)) AS companies FROM postings"
    )
    sql["date_tab_counts"] = POSTINGS + (
        f"SELECT coalesce({month_day('first_seen_at')}, 'Other') AS date_tab, count(*) AS rows, "
        f"{stamp('min(first_seen_at)')} AS earliest FROM postings GROUP BY 1"
    )
    sql["distinct_sizes"] = POSTINGS + (
        "SELECT DISTINCT number_of_people FROM postings WHERE number_of_people NOT IN ('', 'N/A')"
    )
    sql["distinct_categories"] = POSTINGS + (
        f"SELECT DISTINCT {role_category('job_role')} AS role_category FROM postings"
    )
    sql["run_rates"] = (
        "WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS jobs_processed, "
        "count(*) FILTER (event_type = 'signup') AS new_jobs_added, "
        "count(*) FILTER (event_type = 'click') % 40 AS elapsed_seconds FROM events GROUP BY user_id) "
        "SELECT *, CASE WHEN elapsed_seconds < 3 OR jobs_processed = 0 THEN 0 ELSE "
        "CAST(floor(jobs_processed / elapsed_seconds * 60 + 0.5) AS BIGINT) END AS jobs_per_minute, "
        "CAST(floor(new_jobs_added / greatest(jobs_processed, 1) * 100 + 0.5) AS BIGINT) AS new_percent FROM r"
    )

    # top-k, windows, positions
    sql["recent_postings"] = POSTINGS + (
        f"SELECT row_key, company_name, job_role, published_at, {role_category('job_role')} AS role_category "
        "FROM postings WHERE source_website ILIKE '%himalayas%' "
        f"ORDER BY coalesce(published_at, {stamp('first_seen_at')}) DESC, pos DESC LIMIT 50"
    )
    sql["search_roles"] = POSTINGS + (
        "SELECT job_role, company_name, job_url, " + role_category("job_role") + " AS role_category FROM "
        "(SELECT DISTINCT job_role, company_name, job_url FROM postings WHERE source_website ILIKE '%instahyre%' "
        "AND job_role ILIKE '%r_ng%dev%') ORDER BY job_role, company_name, job_url NULLS FIRST LIMIT 50"
    )
    sql["preview_head"] = POSTINGS + "SELECT row_key, company_name FROM postings ORDER BY pos LIMIT 25"
    sql["recent_tail"] = POSTINGS + (
        "SELECT row_key, company_name FROM postings ORDER BY pos DESC LIMIT 25"
    )
    sql["cap_records"] = with_more(FIRST, CURATED) + (
        "SELECT row_key, company_name FROM curated ORDER BY pos LIMIT 500"
    )
    sql["sync_limit"] = POSTINGS + (
        "SELECT row_key, company_name FROM postings ORDER BY pos DESC LIMIT 120"
    )
    sql["feed_offset_slice"] = ONLY_RAW + (
        "SELECT row_key, company_name FROM raw WHERE pos > 40 AND pos <= 180"
    )
    sql["position_slice_large"] = ONLY_RAW + "SELECT row_key FROM raw WHERE pos > 3000"
    sql["early_stop_prefix"] = ONLY_RAW + (
        ", n AS (SELECT *, row_number() OVER (PARTITION BY source_website ORDER BY pos) AS i FROM raw), "
        "g AS (SELECT *, i - coalesce(max(CASE WHEN is_new THEN i END) OVER (PARTITION BY source_website ORDER BY i), 0) AS streak FROM n), "
        "cut AS (SELECT source_website, min(i) AS c FROM g WHERE streak >= 9 GROUP BY ALL) "
        "SELECT row_key, source_website, is_new FROM n LEFT JOIN cut USING (source_website) WHERE c IS NULL OR i <= c"
    )
    sql["application_rownum"] = APPS + (
        "SELECT contact, role_category, row_number() OVER (PARTITION BY role_category ORDER BY applied_at, contact) "
        "AS row_number FROM apps"
    )
    sql["batch_100"] = ONLY_RAW + (
        f", t AS (SELECT row_key, pos, {month_day('first_seen_at')} AS date_tab FROM raw) SELECT row_key, date_tab, "
        "(row_number() OVER (PARTITION BY date_tab ORDER BY pos) - 1) // 10 AS batch_no FROM t"
    )

    # export rows
    sql["posting_row"] = POSTINGS + (
        "SELECT company_name, job_role, coalesce(nullif(location, ''), 'N/A') AS location, number_of_people, "
        "coalesce(nullif(posted_by, ''), 'N/A') AS posted_by, posted_date, "
        "CASE WHEN is_new THEN 'NEW' ELSE 'EXISTING' END AS status FROM postings"
    )
    sql["export_name"] = POSTINGS + (
        "SELECT 'Instahyre_Jobs_Master_' || count(*) AS name FROM postings"
    )
    files = " ".join(f"WHEN {q(k)} THEN {q('Himalayas_' + v)}" for k, v in fixed.CATEGORY_FILES.items())
    sql["category_export_name"] = with_more(RULES, TERMS, matches("postings")) + (
        f"SELECT DISTINCT category_id, CASE category_id {files} END AS name FROM matched"
    )
    sql["route_master_tabs"] = POSTINGS + (
        "SELECT row_key, 'All Jobs' AS tab FROM postings UNION ALL SELECT row_key, CASE WHEN is_new THEN "
        "'New Jobs Only' ELSE 'Existing Jobs Only' END FROM postings"
        + "".join(
            f" UNION ALL SELECT row_key, {q(n)} FROM postings WHERE {bucket_test('number_of_people', n)}"
            for n in fixed.SIZE_BUCKETS
        )
    )
    qa = "category_id = 'qa_automation'"
    fits = under_100("number_of_people")
    sql["route_category_tabs"] = with_more(*chain) + (
        f"SELECT row_key, keyword AS tab FROM matched WHERE {qa} UNION ALL "
        f"SELECT row_key, keyword || ' (<100)' FROM matched WHERE {qa} AND {fits} UNION ALL "
        f"SELECT row_key, 'All QA & Test Automation Jobs' FROM per_category WHERE {qa} UNION ALL "
        f"SELECT row_key, '< 100 People (All)' FROM per_category WHERE {qa} AND {fits}"
    )
    sql["route_application_tabs"] = APPS + (
        "SELECT replace(role_category, '/', '-') AS tab, row_number() OVER (PARTITION BY role_category ORDER BY "
        "applied_at, contact) AS row_number, name, contact, coalesce(linkedin_url, '') AS linkedin_url, job_role, "
        "company_name, coalesce(job_url, '') AS job_url, '' AS current_salary, expected_salary, notice_period, "
        f"coalesce(resume_filename, 'No resume') AS resume_filename, {stamp('applied_at')} AS applied_at FROM apps"
    )
    sql["route_date_tabs"] = POSTINGS + (
        f"SELECT row_key, {month_day('first_seen_at')} AS date_tab FROM postings"
    )
    sql["write_application"] = APPS + (
        "SELECT trim(name) AS name, contact, trim(job_role) AS job_role, nullif(company_name, '') AS company_name, "
        f"job_url, role_category, CASE WHEN job_url IS NULL THEN {q(views.STORED_AT)} ELSE {q(views.AS_OF)} END AS applied_at FROM apps"
    )

    # feeds
    sql["feed_a_postings"] = (
        f"SELECT l_orderkey AS page_pos, {_AT} AS at, s_name AS company_name, p_name AS job_role, "
        "CASE WHEN l_linenumber % 3 = 0 THEN 'https://guid.example.com/' ELSE 'https://apply.example.com/' END || "
        f"CAST(l_partkey AS VARCHAR) AS job_url, {views.SLUG} AS company_slug, "
        "CAST(900000000 + l_partkey * 60 AS VARCHAR) AS published_at, CASE l_linenumber % 3 WHEN 0 THEN 'Remote' "
        f"WHEN 1 THEN 'Spain' ELSE 'Spain, Italy' END AS location, 'himalayas.app' AS source_website FROM {_FEED_FROM}"
    )
    ident = "CAST(l_partkey AS VARCHAR)"
    sql["feed_b_postings"] = (
        f"SELECT l_orderkey AS page_pos, {_AT} AS at, s_name AS company_name, p_name AS job_role, "
        "CASE l_suppkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '500' WHEN 3 THEN '7' END AS employee_count_raw, "
        f"{views.FEED_B_URL} AS job_url, {ident} AS job_id FROM {_FEED_FROM}"
    )
    sql["location_resolve"] = (
        f"SELECT l_orderkey AS page_pos, {_AT} AS at, CASE l_linenumber WHEN 1 THEN 'Pune, Delhi' WHEN 2 THEN 'Oslo' "
        "WHEN 3 THEN 'Kochi, Indore' WHEN 4 THEN 'Rome' WHEN 5 THEN 'New Delhi' WHEN 6 THEN 'Lima' ELSE 'N/A' END "
        f"AS location FROM {_FEED_FROM}"
    )
    sql["first_source_date"] = (
        f"SELECT l_orderkey AS page_pos, {_AT} AS at, CASE l_partkey % 5 WHEN 0 THEN 'Yesterday' WHEN 1 THEN "
        f"{calendar_age('make_timestamp(1004500000000000)', AS_OF)} WHEN 3 THEN "
        f"{calendar_age('make_timestamp(1003000000000000)', AS_OF)} END AS posted_date FROM {_FEED_FROM}"
    )

    # pages
    table("pages", "scan_pages", "page_id", url="url", digest="md5(html)")
    for name, kind in (
        ("extract_jsonld", "json_ld"), ("extract_hydration", "hydration"), ("extract_cards", "dom_card"),
        ("extract_tables", "table"), ("extract_detail", "detail_page"),
    ):
        sql[name] = _tier_rows(kind)
    sql["extract_tiered"] = (
        f"SELECT page_id, company_name, job_role, source_type FROM ({_TIERED})"
    )
    sql["union_tiers"] = (
        "SELECT page_id, company_name, job_role, source_type FROM ("
        + _tier_rows("json_ld", "p_partkey % 5 = 0") + " UNION ALL "
        + _tier_rows("table", "p_partkey % 5 IN (3, 4)") + ")"
    )
    sql["follow_detail"] = (
        f"SELECT p_partkey AS page_id, CASE WHEN p_size > 25 THEN {_PART_COMPANY} ELSE 'Known Corp' END AS company_name, "
        "CASE WHEN p_size > 25 THEN p_name ELSE 'Role ' || p_name END AS job_role, CASE WHEN p_size > 25 THEN n.out ELSE 'N/A' END "
        f"AS number_of_people FROM part JOIN {sized('(SELECT p_partkey AS k, CAST(p_size AS VARCHAR) || ' + q(' people') + ' AS t FROM part)', 't', 'out')} n ON n.k = p_partkey"
    )
    sql["extract_stored_pages"] = (
        "SELECT page_id, CASE k WHEN 0 THEN 'Firm ' || page_id || ' Works' ELSE 'Union ' || page_id || ' Labs' END AS company_name, "
        "CASE k WHEN 0 THEN 'Painter ' || page_id ELSE 'Welder' END AS job_role, CASE k WHEN 0 THEN (page_id % 90 + 2) || ' people' END AS employee_count_raw, "
        "'dom_card' AS source_type FROM pages, (VALUES (0), (1)) t(k) WHERE contains(html, '</body>')"
    )
    made = (
        f"SELECT p_partkey AS ingest_pos, CASE WHEN p_size > 25 THEN {_PART_COMPANY} ELSE 'Known ' || p_partkey % 40 || ' Corp' END AS company_name, "
        "CASE WHEN p_size > 25 THEN p_name ELSE 'Role ' || p_name END AS job_role, CASE WHEN p_size > 25 THEN p_size || ' people' "
        "WHEN s_suppkey IS NOT NULL THEN 'Team size: ' || s_suppkey * 7 END AS t FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 40 AND s_suppkey < 30"
    )
    sql["curated_with_pages"] = (
        f"SELECT ingest_pos, company_name, job_role, number_of_people FROM {sized(f'({made})', 't')} WHERE {eligible('number_of_people')} AND {VALID}"
    )
    people = "CAST(s_suppkey % 300 AS VARCHAR)"
    sql["company_size_once"] = with_more(
        f"page_sizes AS (SELECT * FROM {sized('(SELECT ' + q('https://jobs.example.com/company/') + ' || ' + views.SLUG + ' AS u, ' + q('Team size:  ') + ' || ' + people + ' AS t FROM supplier WHERE s_suppkey % 4 <> 1)', 't', 'size')})",
        f"firsts AS (SELECT {key('company_name')} AS k, arg_min(company_url, pos) AS u FROM postings "
        f"WHERE number_of_people = 'N/A' AND {key('company_name')} <> '' GROUP BY 1)",
        "answers AS (SELECT k, coalesce(size, 'N/A') AS size FROM firsts LEFT JOIN page_sizes USING (u))",
    ) + (
        "SELECT row_key, company_name, CASE WHEN number_of_people = 'N/A' THEN coalesce(size, 'N/A') ELSE "
        f"number_of_people END AS number_of_people FROM postings LEFT JOIN answers ON k = {key('company_name')}"
    )
    next_url = "'https://board.example.com/list?page=' || CAST(p_partkey AS VARCHAR)"
    sql["next_page_link"] = (
        f"SELECT p_partkey AS page_id, {_PART_PAGE} AS page_url, {next_url} AS next_url FROM part"
    )
    sql["unvisited"] = (
        f"SELECT p_partkey AS page_id, {next_url} AS url FROM part WHERE {next_url} NOT IN "
        "(SELECT 'https://board.example.com/list?page=1' || CAST(p_partkey AS VARCHAR) FROM part)"
    )
    sql["traverse_pages"] = (
        "SELECT 'https://board.example.com/list?page=' || CAST(s.p_partkey AS VARCHAR) AS start_url, "
        "v.p_partkey - s.p_partkey + 1 AS page_no, 'https://board.example.com/list?page=' || CAST(v.p_partkey AS VARCHAR) AS url, "
        "CAST(CASE WHEN v.p_partkey % 10 = 9 THEN 0 ELSE 1 END AS BIGINT) AS records FROM part s JOIN part v "
        "ON v.p_partkey BETWEEN s.p_partkey AND s.p_partkey + 7 AND v.p_partkey // 10 = s.p_partkey // 10"
    )

    # streaming
    stream = (
        "WITH s AS (SELECT o_orderkey AS ingest_pos, 'Customer ' || CAST(o_custkey AS VARCHAR) AS company_name, "
        "'role ' || o_orderpriority AS job_role, CASE WHEN o_orderstatus = 'F' THEN '1 - 10 employees' ELSE 'N/A' END "
        "AS number_of_people, o_orderdate, o_custkey, o_orderstatus, o_orderkey // 20 AS page, (o_orderkey - low) * 3 // (high - low + 1) AS batch "
        f"FROM orders, (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders)), k AS (SELECT *, {key('company_name')} || '::' || "
        f"{key('job_role')} AS dedupe_key FROM s) "
    )
    sql["stream_ingest"] = stream + "SELECT ingest_pos, company_name, job_role, number_of_people FROM s"
    sql["stream_dedupe"] = stream + (
        "SELECT dedupe_key, ingest_pos, company_name, job_role, number_of_people FROM k "
        "QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY ingest_pos) = 1"
    )
    clean_role = clean_label("job_role")
    no_url = "CAST(NULL AS VARCHAR)"
    sql["stream_upsert"] = stream + (
        ", f AS (SELECT dedupe_key, arg_min(company_name, ingest_pos) AS company_name, arg_min(job_role, ingest_pos) AS job_role, "
        "arg_min(number_of_people, ingest_pos) AS number_of_people, arg_min(o_orderdate, ingest_pos) AS d FROM k GROUP BY 1) "
        f"SELECT {fingerprint('company_name', clean_role, no_url)} AS fingerprint, "
        f"company_name, {clean_role} AS job_role, number_of_people, {stamp('d')} AS published_at, CAST(1 AS BIGINT) AS scrape_count, "
        f"{q(views.AS_OF)} AS first_seen_at FROM f"
    )
    seen_at = fingerprint("company_name", clean_role, no_url)
    sql["stream_progress"] = stream + (
        f", p AS (SELECT *, {seen_at} AS fp, {key('company_name')} AS company, {clean_role} AS role FROM k), held AS (SELECT DISTINCT fp FROM p "
        "WHERE o_orderstatus = 'F'), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY ingest_pos) = 1), "
        "n AS (SELECT *, fp NOT IN (SELECT fp FROM held) AND row_number() OVER (PARTITION BY fp ORDER BY ingest_pos) = 1 AS is_new, "
        "row_number() OVER (PARTITION BY company ORDER BY ingest_pos) = 1 AS first_of_company FROM f), "
        "pages AS (SELECT page, min(batch) AS batch FROM s GROUP BY page), steps AS (SELECT DISTINCT batch FROM s) "
        "SELECT batch, (SELECT count(*) FROM pages WHERE pages.batch <= steps.batch) AS pages_processed, "
        "(SELECT count(*) FROM s WHERE s.batch <= steps.batch) AS jobs_discovered, "
        "(SELECT count(*) FROM n WHERE n.batch <= steps.batch) AS jobs_processed, "
        "(SELECT count(*) FROM n WHERE n.batch <= steps.batch AND first_of_company) AS companies_discovered, "
        "(SELECT count(*) FROM s WHERE s.batch <= steps.batch) - (SELECT count(*) FROM n WHERE n.batch <= steps.batch) AS duplicates_removed, "
        "(SELECT count(*) FROM n WHERE n.batch <= steps.batch AND number_of_people = 'N/A') AS missing_employee_counts, "
        "(SELECT count(*) FROM n WHERE n.batch <= steps.batch AND is_new) AS new_jobs_added, "
        "(SELECT count(*) FROM n WHERE n.batch <= steps.batch AND NOT is_new) AS existing_jobs_seen, "
        "(SELECT string_agg(t, ';' ORDER BY ingest_pos) FROM (SELECT ingest_pos, ingest_pos || '|' || company_name || '|' || role || '|' "
        "|| number_of_people || '|' || is_new AS t FROM n WHERE n.batch <= steps.batch ORDER BY ingest_pos DESC LIMIT 25)) AS recent_jobs FROM steps"
    )
    sql["profile_refresh"] = stream + (
        "SELECT DISTINCT 'customer-' || CAST(o_custkey AS VARCHAR) AS company_slug, company_name, CASE WHEN c_nationkey > 4 "
        "THEN CAST(c_nationkey AS VARCHAR) || '-50' ELSE 'N/A' END AS employee_count FROM s JOIN customer ON c_custkey = o_custkey"
    )
    return sql
