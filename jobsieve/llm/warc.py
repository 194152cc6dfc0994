"""Derived WARC records: each response gives a linked metadata and a plain-text conversion record.

Both name the response in WARC-Refers-To and carry its target, header block and payload digest; ids
are name-based, so a repeated run writes the same records.  The metadata record is a list of fields
(title, language, outlinks, lengths and digests), the conversion record the page's visible text.
Everything is said with string functions, row by row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CRLF = "\r\n"

# Entities that are replaced in text, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
)

# What goes with its content, what ends a line, what else is a tag.
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script[^>]*>", r"(?is)<style\b.*?</style[^>]*>", r"(?is)<head\b.*?</head[^>]*>")
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header|title|body|html|pre|blockquote)\b[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)"
LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'>]*)"
STEPS = ((r"[ \t\f\x0B\r]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""))


def _unescaped(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def visible_text(html: Column) -> Column:
    """The text of a page: hidden parts and tags gone, one line per block."""
    text = F.regexp_replace(html, r"\n", " ")
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    text = _unescaped(F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, ""))
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    return text


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based urn:uuid in angle brackets."""
    digest = F.md5(F.concat_ws("\n", F.lit(kind), *parts))
    cuts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records (page_id, record_id, target_uri, headers, payload) of stored pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)
    )
    page = F.col("page_id").cast("long")
    return pages.select(
        page.alias("page_id"), record_id("response", F.coalesce(page.cast("string"), F.lit("")), url, F.sha1(html.cast("binary"))).alias("record_id"),
        url.alias("target_uri"), headers.alias("headers"), html.alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: metadata (application/warc-fields) and conversion (text/plain).

    (page_id, record_type, record_id, refers_to, target_uri, content_type, source_headers, payload_digest,
    block_digest, content_length, content).  Digests are sha1 in hexadecimal; content_length counts bytes.

    Null urls and pages are empty: the conversion record then has no content.  Rows without id and
    repeated rows are derived like any other; equal responses give equal records.  Extra columns are
    ignored.  An empty table gives no rows.
    """
    payload = F.col("payload")
    title = F.regexp_replace(_unescaped(F.regexp_extract(payload, TITLE, 1)), r"\s+", " ")
    links = F.regexp_extract_all(payload, F.lit(LINK), F.lit(1))
    digest = F.concat(F.lit("sha1:"), F.sha1(payload.cast("binary")))
    fields = F.concat(
        F.lit("title: "), title, F.lit(f"{CRLF}language: "), F.regexp_extract(payload, LANG, 1),
        F.lit(f"{CRLF}payload-length: "), F.octet_length(payload).cast("string"), F.lit(f"{CRLF}payload-digest: "), digest, F.lit(CRLF),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"\s+", ""), F.lit(CRLF))), ""),
    )
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("type"), visible_text(payload).alias("content")),
    ))
    derived = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "headers", digest.alias("payload_digest"), kinds.alias("r"))
    content = F.col("r.content")
    return derived.select(
        "page_id", F.col("r.kind").alias("record_type"), record_id("derived", F.col("r.kind"), F.col("refers_to")).alias("record_id"), "refers_to",
        "target_uri", F.col("r.type").alias("content_type"), F.col("headers").alias("source_headers"), "payload_digest",
        F.concat(F.lit("sha1:"), F.sha1(content.cast("binary"))).alias("block_digest"),
        F.octet_length(content).cast("long").alias("content_length"), content.alias("content"),
    )


def warc_text(records: DataFrame, at: str) -> DataFrame:
    """(page_id, record): the records as they stand in a WARC file; ``at`` is the moment of the derivation, as 2026-01-31T12:00:00Z."""
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Date: {at}{CRLF}WARC-Record-ID: "), F.col("record_id"),
        F.lit(f"{CRLF}WARC-Refers-To: "), F.col("refers_to"), F.lit(f"{CRLF}WARC-Target-URI: "), F.col("target_uri"),
        F.lit(f"{CRLF}WARC-Block-Digest: "), F.col("block_digest"), F.lit(f"{CRLF}WARC-Payload-Digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}Content-Type: "), F.col("content_type"), F.lit(f"{CRLF}Content-Length: "), F.col("content_length").cast("string"),
    )
    return records.select("page_id", F.concat(head, F.lit(2 * CRLF), F.col("content"), F.lit(2 * CRLF)).alias("record"))
