"""HTML pages as rows of elements, and links resolved against their page."""

from __future__ import annotations

import contextlib
from html.parser import HTMLParser

from pyspark.sql import Column, functions as F

from jobsieve.functions.let import let
from jobsieve.functions.text import strip

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# an opening tag closes an open element of these kinds first
_CLOSES = {
    "p": ("p",),
    "li": ("li",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_SCOPES = frozenset(("table", "ul", "ol", "select", "body", "article", "div", "section"))


class Tokens(HTMLParser):
    """Collects [tag, parent, last, attrs, text] rows in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: list | None, text: str | None) -> int:
        at = len(self.rows)
        self.rows.append([tag, self.open[-1] if self.open else -1, at, attrs, text])
        return at

    def _close(self, depth: int) -> None:
        last = len(self.rows) - 1
        for at in self.open[depth:]:
            self.rows[at][2] = last
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[depth]][0]
            if name in _CLOSES.get(tag, ()):
                self._close(depth)
            elif name in _SCOPES:
                break
        first_wins = dict(reversed([(k, v or "") for k, v in attrs]))
        at = self._add(tag, list(first_wins.items()), None)
        if tag not in _VOID:
            self.open.append(at)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        inside = self.rows[self.open[-1]][0] if self.open else ""
        self._add("#raw" if inside in ("script", "style", "template") else "#text", None, data)

    def read(self, html: str) -> list[list]:
        """The element rows; of markup that the parser gives up on, those read so far."""
        with contextlib.suppress(AssertionError):
            self.feed(html)
            self.close()
        self._close(0)
        return self.rows


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a link against the URL of its page."""
    return let(strip(href), lambda h: _resolve(base, h))


def _resolve(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.regexp_replace(F.substr(page, F.length(origin) + 1), "[^/]*$", "")
    below = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href == "", base)
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.split_part(base, F.lit("#"), F.lit(1)), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(href)))
        .otherwise(F.concat(origin, _without_dots(F.concat(below, href))))
    )


def _without_dots(path: Column) -> Column:
    """Apply '.' and '..' segments of a path; query and fragment stay."""
    plain = F.regexp_extract(path, r"^([^?#]*)", 1)
    tail = F.substr(path, F.length(plain) + 1)
    steps = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1)))
        .otherwise(F.concat(kept, F.array(s))),
    )
    trimmed = F.array_join(steps, "/")
    closed = F.when(plain.rlike(r"/\.\.?$"), F.concat(trimmed, F.lit("/"))).otherwise(trimmed)
    clean = F.when(plain.rlike(r"(^|/)\.\.?(/|$)"), closed).otherwise(plain)
    return F.concat(clean, tail)
