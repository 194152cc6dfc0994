"""What a stored page offers, in one parse: scripts, cards, tables, a detail heading, next links.

The Arrow function below only selects: it finds elements by the fixed selectors and hands over their texts and
links.  Cleaning, validation, JSON items and URL rules are expressions over these rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from jobsieve import fixed
from jobsieve.functions.text import SPACES
from jobsieve.sources.markup import Tokens

LINKS, JSON_LD, HYDRATION, CARDS, TABLES, DETAIL = range(6)

JSON_LD_SCRIPT = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
NEXT_DATA_SCRIPT = r"(?is)<script\b[^>]*\bid\s*=\s*[\"']?__NEXT_DATA__[\"']?[^>]*>(.*?)</script>"
_JSON_LD = re.compile(JSON_LD_SCRIPT, re.ASCII)
_NEXT_DATA = re.compile(NEXT_DATA_SCRIPT, re.ASCII)
_NEXT_WORD = re.compile(r"\bnext\b", re.IGNORECASE)
_NEXT_TEXT = re.compile(fixed.NEXT_TEXT_PATTERN, re.IGNORECASE)
_PAGES_PER_BATCH = 64

_TEXTS = ("body", "company", "role", "size", "compound", "company_link", "meta_inner", "meta", "mention", "link", "company_href")
SCHEMA = (
    "page_id bigint, url string, tier int, at0 bigint, at1 bigint, " + ", ".join(f"{n} string" for n in _TEXTS)
    + ", others array<string>, button boolean"
)
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("tier", pa.int32()), ("at0", pa.int64()), ("at1", pa.int64())]
    + [(n, pa.string()) for n in _TEXTS] + [("others", pa.list_(pa.string())), ("button", pa.bool_())]
)


class _Page:
    """The elements of a page as rows [tag, parent, last, attributes, text] in document order."""

    def __init__(self, html: str):
        self.rows = Tokens().read(html)
        for row in self.rows:
            row[3] = dict(row[3]) if row[3] else {}

    def pieces(self, at: int) -> list[str]:
        return [r[4] for r in self.rows[at + 1 : self.rows[at][2] + 1] if r[0] == "#text"]

    def raw(self, at: int) -> str:
        return "".join(self.pieces(at))

    def text(self, at: int | None) -> str | None:
        """The pieces of text below an element, each trimmed."""
        return None if at is None else "".join(p.strip(SPACES) for p in self.pieces(at))

    def below(self, at: int | None) -> range:
        return range(0) if at is None else range(at + 1, self.rows[at][2] + 1)

    def attr(self, at: int | None, name: str) -> str:
        return "" if at is None else self.rows[at][3].get(name, "")

    def first(self, places, test) -> int | None:
        return next((k for k in places if test(self.rows[k][0], self.rows[k][3])), None)


def _has(value: str, parts) -> bool:
    return any(p in value for p in parts)


def _element(tag: str) -> bool:
    return tag[0] != "#"


def _by_class(classes, *more):
    """Test of an element: its class contains one of the words, or another test of its attributes holds."""
    return lambda tag, a: _element(tag) and (_has(a.get("class", ""), classes) or any(m(a) for m in more))


def _link(paths=None):
    return lambda tag, a: tag == "a" and "href" in a and (paths is None or _has(a["href"], paths))


def _selector(tag: str | None, tests):
    def holds(name: str, a: dict) -> bool:
        for key, kind, text in tests:
            value = a.get(key, "")
            if not (text in re.split(r"[ \t\n\x0b\f\r]+", value) if kind == "word" else text in value):
                return False
        return _element(name) if tag is None else name == tag

    return holds


_SELECTORS = [_selector(tag, tests) for tag, tests in fixed.CARD_SELECTORS]
_TITLED = _by_class(fixed.ROLE_CLASSES, lambda a: "title" in a.get("data-testid", ""))
_COMPOUND = _by_class(fixed.COMPOUND_CLASSES, lambda a: fixed.COMPOUND_CLASS_WORDS[0] in re.split(r"[ \t\n\x0b\f\r]+", a.get("class", "")))
_HIRING = lambda a: a.get("itemprop", "") == "hiringOrganization"
_COMPANY = _by_class(fixed.COMPANY_CLASSES, lambda a: "company" in a.get("data-testid", ""), _HIRING)
_META, _SIZE = _by_class(fixed.META_CLASSES), _by_class(fixed.HEADCOUNT_CLASSES)


def _secondary(tag: str, a: dict) -> bool:
    classes = a.get("class", "").lower()
    return tag in ("span", "div") and not _has(classes, fixed.SECONDARY_SKIP_CLASSES) and _has(classes, fixed.SECONDARY_CLASSES)


def _first_not_none(*found: int | None) -> int | None:
    return next((f for f in found if f is not None), None)


def _cards(page: _Page) -> Iterator[dict]:
    """The fields of each element of the first selector that hits at least twice."""
    for selector in _SELECTORS:
        cards = [k for k, row in enumerate(page.rows) if selector(row[0], row[3])]
        if len(cards) >= 2:
            break
    else:
        return
    for number, card in enumerate(cards):
        nodes = page.below(card)
        role = _first_not_none(
            page.first(nodes, lambda tag, a: tag in fixed.ROLE_TITLE_TAGS),
            page.first(nodes, _TITLED),
            page.first(nodes, lambda tag, a: tag == "a" and "href" in a and _has(a["href"].lower(), fixed.ROLE_LINK_PATHS)),
        )
        compound, meta = page.first(nodes, _COMPOUND), page.first(nodes, _META)
        mention = None
        if "employee" in page.raw(card).lower():
            mention = next(
                (k for k in nodes if page.rows[k][0] in ("span", "div", "p") and "employee" in page.raw(k).lower()
                 and len(page.text(k)) < fixed.HEADCOUNT_TEXT_LIMIT), None,
            )
        within = page.below(role) if role is not None and page.rows[role][0] != "a" else range(0)
        link = _first_not_none(page.first(nodes, _link(fixed.JOB_LINK_PATHS)), page.first(within, _link()), page.first(nodes, _link()))
        yield {
            "tier": CARDS, "at0": number, "role": page.text(role), "compound": None if compound is None else page.raw(compound),
            "company": page.text(page.first(nodes, _COMPANY)), "company_link": page.text(page.first(nodes, _link(fixed.COMPANY_NAME_LINK_PATHS))),
            "meta_inner": page.text(page.first(page.below(meta), lambda tag, a: tag in fixed.META_INNER_TAGS)), "meta": page.text(meta),
            "size": page.text(page.first(nodes, _SIZE)), "mention": page.text(mention), "link": page.attr(link, "href"),
            "company_href": page.attr(page.first(nodes, _link(fixed.COMPANY_LINK_PATHS)), "href"),
            "others": [page.text(k) for k in nodes if _secondary(page.rows[k][0], page.rows[k][3])],
        }


def _tables(page: _Page) -> Iterator[dict]:
    """The rows of tables whose header names a role and a company column."""
    for table_no, table in enumerate(k for k, row in enumerate(page.rows) if row[0] == "table"):
        nodes = page.below(table)
        headers = [page.raw(k).strip(SPACES).lower() for k in nodes if page.rows[k][0] == "th"]

        def column(words, headers=headers) -> int | None:
            return next((n for n, h in enumerate(headers) if _has(h, words)), None)

        role, company, size = map(column, (fixed.TABLE_ROLE_WORDS, fixed.TABLE_COMPANY_WORDS, fixed.TABLE_SIZE_WORDS))
        if role is None or company is None:
            continue
        for row_no, row in enumerate([k for k in nodes if page.rows[k][0] == "tr"][1:]):
            cells = [page.raw(k).strip(SPACES) for k in page.below(row) if page.rows[k][0] in ("td", "th")]

            def cell(n: int | None, cells=cells) -> str | None:
                return cells[n] if n is not None and n < len(cells) else None

            yield {"tier": TABLES, "at0": table_no, "at1": row_no, "role": cell(role), "company": cell(company), "size": cell(size)}


def _detail(page: _Page) -> dict:
    """The heading, company and size elements of a page about one posting."""
    whole = range(len(page.rows))
    bars = [k for k, row in enumerate(page.rows) if "topline" in re.split(r"[ \t\n\x0b\f\r]+", row[3].get("class", ""))]
    named = lambda tag, a: _element(tag) and _has(a.get("class", ""), ("company-name",))
    company = _first_not_none(
        next((k for k in whole if named(page.rows[k][0], page.rows[k][3])
              or (page.rows[k][0] in ("strong", "b") and any(b < k <= page.rows[b][2] for b in bars))), None),
        page.first(whole, _by_class(("company", "employer"), _HIRING)),
        page.first(whole, _link(("/company/", "/employer/"))),
    )
    return {
        "tier": DETAIL, "company": page.text(company), "role": page.text(page.first(whole, lambda tag, a: tag == "h1")),
        "size": page.text(page.first(whole, _SIZE)),
    }


def _next_links(page: _Page) -> dict:
    """The links that lead on, best first (rel=next, aria-label, link text), and whether a script button does."""
    whole = range(len(page.rows))

    def says_next(k: int) -> bool:
        return _NEXT_TEXT.search(page.raw(k).strip(SPACES)) is not None

    def turns(k: int) -> bool:
        tag, parent, _, a, _ = page.rows[k]
        if tag not in ("li", "span", "button", "a", "div"):
            return False
        words = re.split(r"[ \t\n\x0b\f\r]+", a.get("class", "").lower())
        off = "hidden" in words or "disabled" in words or "disabled" in a or a.get("aria-disabled", "") == "true"
        acts = any(name in a for name in ("ng-click", "onclick", "data-page", "data-action"))
        block = parent >= 0 and "pagination" in page.rows[parent][3].get("class", "")
        return not off and (acts or block) and says_next(k)

    found = [
        page.first(whole, lambda tag, a: tag in ("link", "a") and _NEXT_WORD.search(a.get("rel", ""))),
        page.first(whole, lambda tag, a: tag == "a" and "href" in a and _NEXT_WORD.search(a.get("aria-label", ""))),
        *[k for k in whole if page.rows[k][0] == "a" and "href" in page.rows[k][3] and says_next(k)],
    ]
    return {"tier": LINKS, "others": [h for h in (page.attr(k, "href") for k in found if k is not None) if h], "button": any(map(turns, whole))}


def _dicts(node) -> Iterator[dict]:
    """Every dict of a JSON tree in document order, without recursion."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            yield top
            stack.extend(reversed(list(top.values())))
        elif isinstance(top, list):
            stack.extend(reversed(top))


def _hydration_hit(node: dict) -> dict | None:
    by_key = {k.lower(): v for k, v in reversed(list(node.items()))}

    def pick(keys):
        return next((k for k in keys if k in by_key), None)

    role = by_key.get(pick(fixed.HYDRATION_ROLE_KEYS))
    company = by_key.get(pick(fixed.HYDRATION_COMPANY_KEYS))
    if isinstance(company, dict):
        company = company.get("name") or company.get("title")
    if not (isinstance(role, str) and isinstance(company, str) and role and company):
        return None
    size_key = pick(fixed.HYDRATION_SIZE_KEYS)
    return {"company": company, "role": role, "size": None if size_key is None else str(by_key[size_key] or "")}


def _hydration(html: str) -> Iterator[dict]:
    script = _NEXT_DATA.search(html) if "__NEXT_DATA__" in html else None
    if script is None or not script[1]:
        return
    try:
        tree = json.loads(script[1].strip())
    except (ValueError, RecursionError):  # no JSON, or nested beyond what a parser reads
        return
    for number, node in enumerate(_dicts(tree)):
        hit = _hydration_hit(node)
        if hit:
            yield {"tier": HYDRATION, "at0": number, **hit}


def _offers(html: str, tiers: frozenset[int]) -> Iterator[dict]:
    if JSON_LD in tiers and "ld+json" in html:
        for number, body in enumerate(_JSON_LD.findall(html)):
            yield {"tier": JSON_LD, "at0": number, "body": body}
    if HYDRATION in tiers:
        yield from _hydration(html)
    with_tables = TABLES in tiers and "<th" in html.lower()
    if not with_tables and not tiers & {LINKS, CARDS, DETAIL}:
        return
    page = _Page(html)
    if CARDS in tiers:
        yield from _cards(page)
    if with_tables:
        yield from _tables(page)
    if DETAIL in tiers:
        yield _detail(page)
    if LINKS in tiers:
        yield _next_links(page)


def page_parts(pages: DataFrame, *tiers: int) -> DataFrame:
    """The rows of the chosen tiers of all pages; each page is parsed once."""
    wanted = frozenset(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _PAGES_PER_BATCH):
                part = batch.slice(start, _PAGES_PER_BATCH)
                rows = [
                    {"page_id": page_id, "url": url, "at0": 0, "at1": 0, **offer}
                    for page_id, url, html in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)
                    for offer in _offers(html or "", wanted)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
