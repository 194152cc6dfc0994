"""Text cleaning and key functions.

Each rule exists as SQL text (``*_sql``, text in, text out) for use inside
larger rules, and as a Column function.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column, functions as F

from jobsieve import fixed
from jobsieve.functions.let import apply, bind
from jobsieve.functions.let import text as literal

# One character reference: decimal, hexadecimal or named.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REFERS = r"&[^\t\n\f <&;]"
# Lookup tables as one string each, |name=value| with control characters as marks.
_OPEN, _SHUT = "\x01", "\x02"


def _table(pairs: dict) -> str:
    return literal(_OPEN + _OPEN.join(f"{k}{_SHUT}{v}" for k, v in pairs.items()) + _OPEN)


def _by_letter(pairs: dict, key: str) -> str:
    """The part of a lookup table whose names start like the key, short names first: a search reads some hundred letters."""
    letters: dict[str, dict] = {}
    for name in sorted(pairs, key=len):
        letters.setdefault(name[0], {})[name] = pairs[name]
    cases = " ".join(f"WHEN {literal(letter)} THEN {_table(part)}" for letter, part in letters.items())
    return bind(f"substr({key}, 1, 1)", "l", f"CASE l {cases} ELSE {literal(_OPEN)} END")


_NAMED = _by_letter(html5, "b")
# numbers that HTML maps to something other than their own code point
_REMAPPED = _table(
    {n: html.unescape(f"&#{n};") for n in range(256) if html.unescape(f"&#{n};") != chr(n)}
)
# names that are also recognised without their semicolon, longest first
_BARE = "^(?:%s)" % "|".join(
    sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
)


def _found(table: str, key: str, missing: str) -> str:
    """The value of a key in a lookup table."""
    entry = bind(f"locate(concat('{_OPEN}', {key}, '{_SHUT}'), {table})", "p", f"""CASE WHEN p > 0
      THEN substring_index(substr({table}, p + length({key}) + 2), '{_OPEN}', 1)
      ELSE {missing} END""")
    return entry


_CHAR = "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"
_FROM_NUMBER = f"""CASE
  WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\ufffd'
  WHEN n < 256 THEN {_found(_REMAPPED, "CAST(n AS string)", _CHAR)}
  WHEN n BETWEEN 64976 AND 65007 OR n % 65536 IN (65534, 65535) THEN ''
  ELSE {_CHAR} END"""
# over-long numbers become null and so the replacement character
_NUMBER = """CASE WHEN lower(substr(b, 2, 1)) = 'x' THEN
    CASE WHEN length(ltrim('0', translate(b, '#xX;', ''))) <= 8
      THEN try_cast(conv(translate(b, '#xX;', ''), 16, 10) AS bigint) END
  ELSE try_cast(translate(b, '#;', '') AS bigint) END"""
_FROM_BARE = bind(f"regexp_extract(b, {literal(_BARE)}, 0)", "m", f"""CASE
  WHEN m = '' THEN concat('&', b)
  ELSE concat({_found("names", "m", "m")}, substr(b, length(m) + 1)) END""")
_FROM_BODY = f"""CASE
  WHEN startswith(b, '#') THEN {bind(_NUMBER, "n", _FROM_NUMBER)}
  ELSE {bind(_NAMED, "names", _found("names", "b", _FROM_BARE))} END"""


def unescape_sql(x: str) -> str:
    decoded = f"""array_join(zip_with(split(t, {literal(_REFERENCE)}, -1),
      concat(transform(regexp_extract_all(t, {literal(_REFERENCE)}, 0),
        r -> {bind("substr(r, 2)", "b", _FROM_BODY)}), array('')), (p, d) -> concat(p, d)), '')"""
    # an ampersand before a blank is no reference, and most references are &amp;
    return bind(x, "t", f"""CASE WHEN NOT t RLIKE {literal(_REFERS)} THEN t
      WHEN NOT contains(replace(t, '&amp;', ''), '&') THEN replace(t, '&amp;', '&') ELSE {decoded} END""")


def _escaped(chars: str) -> str:
    """A SQL string literal of control and space characters."""
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


# the characters of Unicode's White_Space property, and the control characters that cleaning drops
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CONTROLS = "".join(chr(c) for c in (*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F))
_OTHER_SPACES = "".join(c for c in SPACES if c != " " and c not in _CONTROLS)


def strip_sql(x: str) -> str:
    return f"btrim({x}, {_escaped(SPACES)})"


def strip_name_sql(x: str) -> str:
    """`strip_sql` of a plain name: text that starts and ends with visible ASCII is not searched for spaces."""
    last = f"substr({x}, -1)"
    bare = f"{x} >= '!' AND {x} < {_escaped(chr(127))} AND {last} >= '!' AND {last} < {_escaped(chr(127))}"
    return f"CASE WHEN {bare} THEN {x} ELSE {strip_sql(x)} END"


# printable ASCII without an ampersand or two blanks is clean, apart from blanks at both ends
_PLAIN = literal(r"^[ -~]*+\z")
# text that cleaning leaves as it is: visible ASCII without an ampersand, single blanks inside
CLEAN = r"^[!-%'-~]++(?: [!-%'-~]++)*+\z"
# the same for labels: it starts with a letter and ends with a letter or digit
CLEAN_LABEL = r"^[A-Za-z][!-%'-~]*+(?: [!-%'-~]++)*+(?<=[A-Za-z0-9])\z"


def clean_text_sql(x: str) -> str:
    """Cleaned text of a plain name."""
    return f"CASE WHEN {x} RLIKE {literal(CLEAN)} THEN {x} ELSE {_cleaning_sql(x)} END"


def _cleaning_sql(x: str) -> str:
    # one pass turns every white space into a blank and drops control characters
    blank = bind(unescape_sql("u"), "v", f"""CASE WHEN v RLIKE {_PLAIN} THEN v
      ELSE translate(v, {_escaped(_OTHER_SPACES + _CONTROLS)}, '{' ' * len(_OTHER_SPACES)}') END""")
    single = bind(blank, "b", "CASE WHEN contains(b, '  ') THEN regexp_replace(b, '  +', ' ') ELSE b END")
    clean = f"NOT contains(u, '&') AND NOT contains(u, '  ') AND u RLIKE {_PLAIN}"
    return bind(f"coalesce({x}, '')", "u", f"trim(CASE WHEN {clean} THEN u ELSE {single} END)")


def label_sql(clean: str) -> str:
    """Cleaned text without leading numbering and edge punctuation."""
    # only a digit, ASCII or not, can start a numbering
    numbered = "k >= '0' AND k < ':' OR k >= '\\u0080'"
    unnumbered = f"CASE WHEN {numbered} THEN regexp_replace(k, {literal(r'(?U)^\d+[.)]\s+')}, '') ELSE k END"
    return bind(clean, "k", f"btrim({unnumbered}, {literal(fixed.EDGE_PUNCTUATION)})")


def clean_label_sql(x: str) -> str:
    """Cleaned label of a plain name."""
    return f"CASE WHEN {x} RLIKE {literal(CLEAN_LABEL)} THEN {x} ELSE {label_sql(_cleaning_sql(x))} END"


def letters_sql(clean: str) -> str:
    """Comparison key of cleaned text."""
    return f"regexp_replace(lower({clean}), '[^a-z0-9]+', '')"


def key_sql(x: str) -> str:
    return letters_sql(clean_text_sql(x))


def html_unescape(c: Column) -> Column:
    """Decode HTML character references; strings without an ampersand pass untouched."""
    return apply(unescape_sql("x"), c)


def _simple(c: Column) -> Column:
    """Printable ASCII in which no reference but &amp; occurs: Spark compiles what little there is to clean."""
    return c.rlike(r"^[ -~]*+\z") & ~F.replace(c, F.lit("&amp;"), F.lit("")).rlike(_REFERS)


def _decoded(c: Column) -> Column:
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def clean_text(c: Column) -> Column:
    """`clean_text`: unescape, drop control characters, collapse white space; null -> ''."""
    simple = F.trim(F.regexp_replace(_decoded(c), "  +", " "))
    return F.when(c.rlike(CLEAN), c).when(_simple(c), simple).otherwise(apply(_cleaning_sql("x"), c))


def clean_company(c: Column) -> Column:
    """`clean_company`: cleaned text without leading numbering and edge punctuation."""
    simple = F.trim(F.regexp_replace(_decoded(c), "  +", " "))
    label = F.btrim(F.regexp_replace(simple, r"^[0-9]+[.)]\s+", ""), F.lit(fixed.EDGE_PUNCTUATION))
    return F.when(c.rlike(CLEAN_LABEL), c).when(_simple(c), label).otherwise(apply(label_sql(_cleaning_sql("x")), c))


def clean_role(c: Column) -> Column:
    """`clean_role`: the same rules for a job role."""
    return clean_company(c)


def normalize_key(c: Column) -> Column:
    """`normalize_key`: comparison key; '' for text without Latin letters or digits."""
    letters = F.regexp_replace(F.lower(_decoded(c)), "[^a-z0-9]+", "")
    return F.when(_simple(c), letters).otherwise(apply(letters_sql(_cleaning_sql("x")), c))


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(c, F.lit(SPACES))


def strip_name(c: Column) -> Column:
    """`strip` of a column that costs nothing to read: text with visible ASCII at both ends is not searched for spaces."""
    last = F.substring(c, -1, 1)
    bare = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(bare, c).otherwise(strip(c))


def format_count(c: Column) -> Column:
    """`format_count`: thousands separators; null -> '0'."""
    return F.coalesce(F.format_number(c, 0), F.lit("0"))


def people_label(number: Column, text: Column) -> Column:
    """`format_count`, people variant: a number is formatted, a text passes, else N/A."""
    return F.coalesce(
        F.format_number(number, 0), F.nullif(text, F.lit("")), F.lit(fixed.NOT_AVAILABLE)
    )


def safe_tab_title(c: Column) -> Column:
    """`safe_tab_title`: reserved characters become '_', at most 31 characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"[\\/*?:\[\]]", "_")), 1, 31)


def safe_category_title(c: Column) -> Column:
    """`safe_tab_title`, category variant: separators become '-', other marks go."""
    return F.substring(F.regexp_replace(F.translate(c, "/\\:", "---"), r"[?*\[\]]", ""), 1, 31)


def posted_by_label(name: Column, designation: Column, company: Column) -> Column:
    """`posted_by_label`: 'Name (designation, company)', the name alone, or N/A."""
    def part(c: Column) -> Column:
        return F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))

    who, rest = part(name), F.concat_ws(", ", part(designation), part(company))
    return (
        F.when(who.isNull(), F.lit(fixed.NOT_AVAILABLE))
        .when(rest != "", F.concat(who, F.lit(" ("), rest, F.lit(")")))
        .otherwise(who)
    )
