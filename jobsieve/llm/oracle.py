"""DuckDB SQL for the queries of the operators that SQL can express."""

from __future__ import annotations

from jobsieve.llm import fingerprints, licenses, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_sql() -> str:
    """Places of the base phrases, and templates that some line contains."""
    pattern = licenses.WORD[1:-1]
    places = []
    for phrase in licenses.BASE:
        words = phrase.split(" ")
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(words)} + 1, 0)), lambda i: {same})")
    labels = list(licenses.BASE.values())
    templates = ", ".join(
        f"('{label}', {licenses.template_words(text)!r}, {licenses.needed(len(licenses.template_words(text)))}, {licenses.window(text)}, {list(telling)!r})"
        for label, text, telling in licenses.TEMPLATES
    )
    has = ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{label}' END" for k, label in enumerate(labels))
    every = " || ".join(f"at{k}" for k in range(len(labels)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lt FROM documents
), w AS (
  SELECT r, doc_id, regexp_extract_all(lt, '{pattern}') AS w FROM d
), p AS (
  SELECT r, doc_id, len(w) AS n_words, {', '.join(f'{x} AS at{k}' for k, x in enumerate(places))} FROM w
), b AS (
  SELECT r, doc_id, n_words, {every} AS s, list_filter([{has}], lambda x: x IS NOT NULL) AS base FROM p
), templates(label, words, least, width, telling) AS (VALUES {templates}),
l AS (
  SELECT r, list_distinct(regexp_extract_all(line, '{pattern}')) AS lw FROM (SELECT r, unnest(string_split(lt, chr(10))) AS line FROM d)
), m AS (
  SELECT r, label, len(list_intersect(words, lw)) AS held, len(words) AS size, least FROM l JOIN templates ON list_has_all(lw, telling)
  UNION ALL
  SELECT r, label, len(list_intersect(words, run)), len(words), least FROM (
    SELECT r, label, words, least, telling, unnest(list_transform(range(1, len(w) + 1), lambda s: list_distinct(w[s:s + width - 1]))) AS run
    FROM w JOIN templates ON list_has_all(w, telling)
  ) WHERE list_has_all(run, telling)
), f AS (
  SELECT r, list(DISTINCT label) AS more, max(held / size) AS held FROM m WHERE held >= least GROUP BY r
)
SELECT doc_id, n_words, len(s) AS n_base, list_min(s) AS first_word, list_max(s) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []::VARCHAR[]))), ',') AS labels,
  CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(held, 0)::DOUBLE END AS score
FROM b LEFT JOIN f USING (r)"""


def fingerprint_sql() -> str:
    """Differences of digest sets, without any sketch; the base sketch cell by cell."""
    piece = f"[^\\n]{{1,{fingerprints.PARAGRAPH}}}"

    def digests(text: str) -> str:
        return f"list_distinct(list_transform(regexp_extract_all({text}, '{piece}'), lambda p: ('0x' || substr(md5(p), 1, 15))::BIGINT))"

    cells = fingerprints.BASE
    check = fingerprints._CHECK.format("d")
    return f"""
WITH o AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
), x AS (
  SELECT r, doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM o
), e AS (
  SELECT *, substring(t, 1, n - n // 2) || substring(nt, 1, n // 2) AS et FROM x
), s AS (
  SELECT *, {digests('t')} AS own, {digests('et')} AS cut, {digests('nt')} AS nxt FROM e
), h AS (
  SELECT r, 'own' AS v, unnest(own) AS d FROM s UNION ALL SELECT r, 'cut', unnest(cut) FROM s
), c AS (
  SELECT r, v, d, {check} AS k, unnest([d & {cells - 1}, {cells} + ((d >> 20) & {cells - 1}), {2 * cells} + ((d >> 40) & {cells - 1})]) AS c FROM h
), g AS (
  SELECT r, v, c, count(*) AS n, bit_xor(d) AS d, bit_xor(k) AS k FROM c GROUP BY ALL
), f AS (
  SELECT i.r, i.v, string_agg(concat_ws(':', coalesce(g.n, 0), coalesce(g.d, 0), coalesce(g.k, 0)), ',' ORDER BY i.c) AS fp
  FROM (SELECT r, v, c FROM o, (VALUES ('own'), ('cut')) AS vs(v), range({3 * cells}) AS cs(c)) AS i LEFT JOIN g USING (r, v, c) GROUP BY i.r, i.v
)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN len(own) + len(cut) = 0 THEN 1.0 ELSE 1 - (len(own) + len(cut) - 2 * len(list_intersect(own, cut))) / (len(own) + len(cut)) END AS near_edited,
  CASE WHEN len(own) + len(nxt) = 0 THEN 1.0 ELSE 1 - (len(own) + len(nxt) - 2 * len(list_intersect(own, nxt))) / (len(own) + len(nxt)) END AS near_next
FROM s JOIN f AS a ON a.r = s.r AND a.v = 'own' JOIN f AS b ON b.r = s.r AND b.v = 'cut'"""


def leak_sql(threshold: float = 0.8) -> str:
    """Windows aligned at shared shingles, verified without fingerprints."""
    pattern = licenses.WORD[1:-1]
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')"
    return f"""
WITH d AS (
  SELECT DISTINCT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, w, len(w) AS l, least(len(w), 5) AS k FROM (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), x AS (
  SELECT DISTINCT l, k, o - 1 AS o, list_slice(w, o, o + k - 1) AS s FROM i, unnest(range(1, l - k + 2)) AS u(o)
), p AS (
  SELECT doc_id, q.k, o - 1 AS at, list_slice(w, o, o + q.k - 1) AS s FROM d, (SELECT DISTINCT k FROM i) AS q, unnest(range(1, len(w) - q.k + 2)) AS u(o)
), h AS (
  SELECT DISTINCT p.doc_id, greatest(p.at - x.o, 0) AS st, x.l, x.k FROM p JOIN x ON p.s = x.s AND p.k = x.k
), v AS (
  SELECT DISTINCT doc_id, greatest(least(st, len(w) - l), 0) AS st, l, k, list_slice(w, greatest(least(st, len(w) - l), 0) + 1, greatest(least(st, len(w) - l), 0) + l) AS w
  FROM h JOIN d USING (doc_id)
), t AS (
  SELECT v.doc_id, i.item_id, v.st, len(v.w) AS n,
    list_transform(range(1, len(v.w) - v.k + 2), lambda o: v.w[o:o + v.k - 1]) AS a, list_transform(range(1, i.l - i.k + 2), lambda o: i.w[o:o + i.k - 1]) AS b
  FROM v JOIN i USING (l, k)
), c AS (
  SELECT *, list_sum(list_transform(list_distinct(b), lambda y: least(len(list_filter(a, lambda z: z = y)), len(list_filter(b, lambda z: z = y))))) AS c FROM t
), r AS (
  SELECT doc_id, item_id, st, n, c / (len(a) + len(b) - c) AS sim FROM c
)
SELECT doc_id, item_id, sim::DOUBLE AS similarity, st::BIGINT AS start_word, n::BIGINT AS n_words FROM r WHERE sim >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, st, n DESC) = 1"""


def warc_sql() -> str:
    """The same string rules in DuckDB's functions."""
    text = "regexp_replace(payload, '\\n', ' ', 'g')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern in warc.HIDDEN:
        text = f"regexp_replace({text}, {quoted(pattern)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {quoted(warc.BREAKS)}, chr(10), 'g'), {quoted(warc.TAGS)}, '', 'g')"

    def unescaped(x: str) -> str:
        for name, value in warc.ENTITIES:
            x = f"replace({x}, {quoted(name)}, {quoted(value)})"
        return x

    text = unescaped(text)
    for pattern, by in warc.STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {'chr(10)' if by == chr(10) else quoted(by)}, 'g')"
    title = f"regexp_replace({unescaped(f'regexp_extract(payload, {quoted(warc.TITLE)}, 1)')}, '\\s+', ' ', 'g')"
    crlf = "chr(13) || chr(10)"

    def uuid(x: str) -> str:
        return f"(SELECT '<urn:uuid:' || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) || '>' FROM (SELECT md5({x}) AS m))"

    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), s AS (
  SELECT *, {uuid("concat_ws(chr(10), 'response', coalesce(page_id::VARCHAR, ''), target_uri, sha1(payload))")} AS refers_to,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) || {crlf} AS source_headers,
    'sha1:' || sha1(payload) AS payload_digest FROM p
), r AS (
  SELECT page_id, refers_to, target_uri, source_headers, payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(payload, {quoted(warc.LANG)}, 1) || {crlf} || 'payload-length: ' || strlen(payload)
    || {crlf} || 'payload-digest: ' || payload_digest || {crlf}
    || coalesce(array_to_string(list_transform(regexp_extract_all(payload, {quoted(warc.LINK)}, 1), lambda x: 'outlink: ' || regexp_replace(x, '\\s+', '', 'g') || {crlf}), ''), '') AS content FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_headers, payload_digest, 'conversion', 'text/plain', {text} FROM s
)
SELECT page_id, record_type, {uuid("concat_ws(chr(10), 'derived', record_type, refers_to)")} AS record_id, refers_to, target_uri, content_type, source_headers,
  payload_digest, 'sha1:' || sha1(content) AS block_digest, strlen(content) AS content_length, content FROM r"""


def near_sql(words: int = 3, threshold: int = 85) -> str:
    """All pairs that share a shingle, and the closure of the links."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {words - 1}), ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - {words} + 1, least(len(w), 1)) + 1)) AS u(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) AS t
  JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= {threshold} * (p.n + q.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, k.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) AS k ON k.a = d.doc_id"""


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Every distance to every centroid in every round, from the components themselves."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "part AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept)",
        f"""first AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {k})""",
        "c0 AS (SELECT k, j, x AS c FROM first JOIN part USING (r))",
    ]
    for n in range(rounds + 1):
        steps += [
            f"far{n} AS (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM part JOIN c{n} USING (j) GROUP BY r, k)",
            f"at{n} AS (SELECT r, min(d * {k} + k) AS best FROM far{n} GROUP BY r)",
            f"own{n} AS (SELECT r, best % {k} AS k, best // {k} AS d FROM at{n})",
        ]
        if n < rounds:
            steps += [
                f"sum{n} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM part JOIN own{n} USING (r) GROUP BY k, j)",
                f"""c{n + 1} AS (SELECT c.k, c.j, CASE WHEN s IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
                    FROM c{n} c LEFT JOIN sum{n} m ON c.k = m.k AND c.j = m.j)""",
            ]
    return f"""WITH {', '.join(steps)},
        hashed AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY k),
        size AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM own{rounds} GROUP BY k)
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, s AS cluster_inertia,
            CAST((SELECT sum(s) FROM size) AS BIGINT) AS inertia, h AS centroid_sha256
        FROM own{rounds} JOIN kept USING (r) JOIN hashed USING (k) JOIN size USING (k)"""
