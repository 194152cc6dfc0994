"""Semantic predicates on company, role and headcount text.

As in the text module, each rule exists as SQL text and as a Column function.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobsieve import fixed
from jobsieve.functions.let import apply, bind, text, texts
from jobsieve.functions.text import (
    CLEAN,
    CLEAN_LABEL,
    clean_label_sql,
    clean_text_sql,
    label_sql,
    letters_sql,
    strip_name_sql,
)

_AFFIX = f"(?<![a-z])(?:{'|'.join(fixed.COMPANY_AFFIXES)})(?![a-z])"
# possessive, so that Java loops instead of recursing once per word; the longest words come first
_ONLY_LOCATION_WORDS = (
    f"^[^a-z]*+(?:(?:{'|'.join(sorted(fixed.LOCATION_WORDS, key=len, reverse=True))})(?![a-z])[^a-z]*+)++$"
)
_CITY_AND_CODE = r"^[A-Z\s]+,\s*[A-Z]{2}$"


def _matches(x: str, pattern: str) -> str:
    return f"{x} RLIKE {text(pattern)}"


def location_rules_sql(low: str) -> str:
    """Place test on cleaned text in lower case."""
    # the tests that most names fail at their first letters come first
    by_words = (
        f"({_matches(low, _ONLY_LOCATION_WORDS)} OR (contains({low}, ',') AND {low} RLIKE '[a-z]' AND "
        f"{_matches(f'upper({low})', _CITY_AND_CODE)})) AND NOT {_matches(low, _AFFIX)}"
    )
    return f"({low} IN ({texts(fixed.KNOWN_LOCATIONS)}) OR ({by_words}))"


def location_sql(clean: str) -> str:
    """Place test on text that is already cleaned."""
    return bind(f"lower({clean})", "low", location_rules_sql("low"))


def _noise_rules_sql(s: str, location: str) -> str:
    date = _matches(s, rf"(?iU)\b(?:{fixed.DATE_WORDS})\b")
    salary = _matches(s, rf"(?iU)(?:{fixed.SALARY_MARKS}|\b(?:{fixed.SALARY_WORDS})\b)")
    job_type = _matches(s, rf"(?iU)\b(?:{fixed.JOB_TYPE_WORDS})\b")
    words = f"(length({s}) - length(replace({s}, ' ', '')) + 1)"
    return (
        f"({s} = '' OR {location} OR ({words} <= 5 AND ({date} OR {salary})) "
        f"OR ({words} <= 4 AND {job_type}))"
    )


def noise_sql(x: str) -> str:
    """Noise test of a plain name, on text that is cleaned once; clean text needs no names for what is cleaned."""
    rules = bind(clean_text_sql(x), "s", _noise_rules_sql("s", location_sql(clean_text_sql("s"))))
    return f"CASE WHEN {_matches(x, CLEAN)} THEN {_noise_rules_sql(x, location_rules_sql(f'lower({x})'))} ELSE {rules} END"


def description_rules_sql(s: str) -> str:
    """Description test on text that is already cleaned."""
    starter = _matches(s, rf"(?iU)^(?:{fixed.DESCRIPTION_STARTERS})\b")
    sentence = _matches(s, r"\.\s+[A-Z]")
    return f"({starter} OR (contains({s}, '.') AND {sentence}) OR length({s}) > {fixed.DESCRIPTION_LENGTH})"


def description_sql(clean: str) -> str:
    """The same for an expression, which gets a name."""
    return bind(clean, "s", description_rules_sql("s"))


def _name_rules_sql(c: str, limits: tuple[int, int], extra: str) -> str:
    low, high = limits
    return f"length({c}) >= {low} AND length({c}) <= {high} AND lower({c}) NOT IN ({texts(fixed.UI_ACTIONS)}) AND {extra}"


def _name_sql(raw: str, clean: str, limits: tuple[int, int], extra: str) -> str:
    return f"coalesce({strip_name_sql(raw)} <> '' AND {_name_rules_sql(clean, limits, extra)}, false)"


def company_sql(raw: str, clean: str, label: str) -> str:
    """Company test from the raw value, its cleaned text and the label of that.

    Text that is a label as it is stays the same when it is cleaned again, so the rules read it by its own name.
    """
    extra = bind(
        clean_text_sql("c"), "again", f"NOT {location_sql('again')} AND NOT {description_rules_sql('again')}"
    )
    rules = bind(label, "c", _name_sql(raw, "c", fixed.COMPANY_LENGTH, extra))
    plain = f"NOT {location_rules_sql(f'lower({clean})')} AND NOT {description_rules_sql(clean)}"
    return f"CASE WHEN {_matches(clean, CLEAN_LABEL)} THEN {_name_rules_sql(clean, fixed.COMPANY_LENGTH, plain)} ELSE {rules} END"


def role_sql(raw: str, clean: str, label: str) -> str:
    """Role test from the raw value, its cleaned text and the label of that."""
    bullet = _matches("c", r"^\s*[-•*]\s+")
    rules = bind(label, "c", _name_sql(raw, "c", fixed.ROLE_LENGTH, f"NOT {description_sql(clean_text_sql('c'))} AND NOT {bullet}"))
    # a label that starts with a letter starts with no bullet
    plain = _name_rules_sql(clean, fixed.ROLE_LENGTH, f"NOT {description_rules_sql(clean)}")
    return f"CASE WHEN {_matches(clean, CLEAN_LABEL)} THEN {plain} ELSE {rules} END"


def valid_company_sql(raw: str) -> str:
    return company_sql(raw, raw, clean_label_sql(raw))


def valid_role_sql(raw: str) -> str:
    return role_sql(raw, raw, clean_label_sql(raw))


def valid_names_sql(company: str, role: str, ct: str, rt: str) -> str:
    """Tests of a record's names, given also as cleaned texts ``ct`` and ``rt``."""
    # keys that start with different letters differ
    first = [f"substr(lower({c}), 1, 1)" for c in (ct, rt)]
    differ = " AND ".join([f"{c} >= 'a' AND {c} <= 'z'" for c in first] + [f"{first[0]} <> {first[1]}"])
    return (
        f"({differ} OR {letters_sql(ct)} <> {letters_sql(rt)}) AND {company_sql(company, ct, label_sql(ct))} AND "
        f"{role_sql(role, rt, label_sql(rt))}"
    )


def valid_record_sql(x: str) -> str:
    """All tests of a record (a struct of company, role, people), cheapest first."""
    names = valid_names_sql(f"{x}.company", f"{x}.role", "ct", "rt")
    cleaned = bind(
        clean_text_sql(f"{x}.company"), "ct", bind(clean_text_sql(f"{x}.role"), "rt", names)
    )
    return f"({valid_headcount_sql(f'{x}.people')} AND {cleaned})"


def valid_headcount_sql(x: str) -> str:
    number = r"[0-9]+(?:,[0-9]+)?"
    plain = _matches("h", rf"(?iU)^{number}(?:\s*[-–—]\s*{number})?\s*(?:employees)?$")
    more = _matches("h", rf"(?iU)^more than\s*{number}\s*employees$")
    hedged = _matches("h", rf"(?iU)\b(?:{fixed.HEDGES})\b")
    ok = f"h = {text(fixed.NOT_AVAILABLE)} OR (NOT {hedged} AND ({plain} OR {more}))"
    return f"coalesce({bind(strip_name_sql(x), 'h', ok)}, false)"


def is_location(c: Column) -> Column:
    """`is_location`: a place name, only location words, or 'City, XX'."""
    return apply(location_sql(clean_text_sql("x")), c)


def is_noise(c: Column) -> Column:
    """`is_noise`: blank, location, short date or salary text, short job type."""
    return apply(noise_sql("x"), c)


def is_description(c: Column) -> Column:
    """`is_description`: starter phrase, sentence break, or too long."""
    return apply(description_sql(clean_text_sql("x")), c)


def valid_company(c: Column) -> Column:
    """`valid_company`: a plausible company name."""
    return apply(valid_company_sql("x"), c)


def valid_role(c: Column) -> Column:
    """`valid_role`: a plausible job title."""
    return apply(valid_role_sql("x"), c)


def valid_headcount(c: Column) -> Column:
    """`valid_headcount`: N/A, a count, a range, or 'more than N employees'."""
    return apply(valid_headcount_sql("x"), c)


def valid_names_and_size(company: Column, role: Column, people: Column) -> Column:
    """The `valid_record` test; its three inputs are evaluated once."""
    record = F.struct(company.alias("company"), role.alias("role"), people.alias("people"))
    return apply(valid_record_sql("x"), record)
