"""URL functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobsieve import fixed
from jobsieve.functions.let import let
from jobsieve.functions.text import strip, strip_name


def normalize_url(c: Column) -> Column:
    """`normalize_url`: scheme, host and path without query, fragment, params, end slash."""
    compact = F.ltrim(F.regexp_replace(c, r"[\t\r\n]+", ""))
    path = F.substring_index(F.substring_index(compact, "?", 1), "#", 1)
    return F.lower(F.rtrim(F.regexp_replace(path, r";[^/]*$", ""), F.lit("/")))


def fingerprint(company: Column, role: Column, url: Column) -> Column:
    """`fingerprint`: SHA-256 identity of a posting; the URL joins only when present."""
    base = F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"))
    # concat_ws skips the null that stands for a missing URL
    key = F.concat_ws(
        "||",
        F.lower(strip_name(company)),
        F.lower(strip_name(role)),
        F.when(url != "", F.lower(base)),
    )
    return F.sha2(key, 256)


def company_slug(c: Column) -> Column:
    """`company_slug`: lower case, every other run of characters becomes one '-'."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_from_url(c: Column) -> Column:
    """`slug_from_url`: the segment after /companies/, or null."""
    segment = F.regexp_extract(c, "/companies/([^/]+)", 1)
    return F.nullif(F.trim(F.lower(segment)), F.lit(""))


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(c: Column) -> Column:
    """Lower-case host name, '' when there is none; the rest need not be well-formed."""
    return F.coalesce(F.lower(F.regexp_extract(c, _HOST, 1)), F.lit(""))


def domain_of(c: Column) -> Column:
    """`domain_of`: host without a leading 'www.'; text that is no URL passes."""
    host = F.nullif(host_of(c), F.lit(""))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), c)


def in_scope(candidate: Column, base: Column) -> Column:
    """`in_scope`: same host as the base or one of its subdomains."""
    cand, site = host_of(candidate), host_of(base)
    return (cand == site) | cand.endswith(F.concat(F.lit("."), site))


def url_decode(c: Column) -> Column:
    """Percent-decode a query value; malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(c), F.translate(c, "+", " "))


def query_pairs(url: Column) -> Column:
    """Decoded, non-blank (key, value) pairs of the query string, in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(
            url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"),
            url_decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["value"] != "")


def _first_value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]


def feed_window_params(url: Column) -> Column:
    """`feed_window_params`: struct(offset, page, keyword, search_page) of a feed URL."""
    return let(query_pairs(url), lambda pairs: _window_params(url, pairs))


def _window_params(url: Column, pairs: Column) -> Column:
    offset_text, page_text = _first_value(pairs, "offset"), _first_value(pairs, "page")
    page = F.greatest(F.lit(1).cast("long"), page_text.try_cast("long"))
    offset = (
        F.when(offset_text.rlike("^[0-9]+$"), offset_text.try_cast("long"))
        .when(page_text.rlike("^[0-9]+$"), (page - 1) * fixed.FEED_PAGE_SIZE)
        .otherwise(F.lit(0).cast("long"))
    )
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"^[a-zA-Z][^:/]*://[^/]*", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    section = F.lower(F.get(segments, F.lit(1)))
    from_path = F.when(
        (F.get(segments, F.lit(0)) == "jobs") & ~section.isin(*fixed.RESERVED_JOB_PATHS),
        F.translate(section, "-", " "),
    )
    keyword = F.coalesce(
        *[strip(_first_value(pairs, k)) for k in ("q", "aiq", "query")], from_path
    )
    return F.struct(
        offset.alias("offset"),
        F.when(
            ~F.coalesce(offset_text.rlike("^[0-9]+$"), F.lit(False))
            & page_text.rlike("^[0-9]+$"),
            page - 1,
        ).otherwise(F.lit(0).cast("long")).alias("page"),
        keyword.alias("keyword"),
        F.when(
            (keyword != "") & (offset > 0),
            F.floor(offset / fixed.FEED_PAGE_SIZE).cast("long") + 1,
        ).otherwise(F.lit(1).cast("long")).alias("search_page"),
    )


def city_of_url(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """`city_from_url` as a column: known city suffix, else the word after '-at-...-'."""
    aliases = fixed.CITY_ALIASES if aliases is None else aliases
    path = F.lower(F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/")))
    return let(F.substring_index(path, "/", -1), lambda slug: _city_of_slug(slug, aliases))


def _city_of_slug(slug: Column, aliases: dict[str, str]) -> Column:
    known = F.lit(None).cast("string")
    # Longest alias first, so that 'new-delhi' wins over 'delhi'.
    for alias in sorted(aliases, key=len):
        hit = slug.endswith("-" + alias) | slug.endswith("_" + alias)
        known = F.when(hit, F.lit(aliases[alias])).otherwise(known)
    words = F.initcap(
        F.trim(F.translate(F.regexp_extract(slug, fixed.CITY_AT_PATTERN, 1), "-", " "))
    )
    return F.coalesce(known, F.when(F.length(words) > 2, words))


def job_id_from_url(job_id: Column, url: Column) -> Column:
    """`job_id_from_url`: the id, or the digits of 'job-<digits>-' when it is missing."""
    from_url = F.nullif(F.regexp_extract(url, r"job-(\d+)-", 1), F.lit(""))
    present = ~F.coalesce(job_id, F.lit("")).isin("", "0")
    return F.when(present, job_id).otherwise(from_url)
