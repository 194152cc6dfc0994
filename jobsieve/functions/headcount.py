"""Headcount parsing and size predicates (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobsieve import fixed
from jobsieve.functions.let import apply, bind, let, text, texts
from jobsieve.functions.text import strip, strip_name_sql, strip_sql


def _filled(x: str) -> str:
    """Null for an empty text: casting that to a number would throw and catch an exception per row."""
    return bind(x, "g", "CASE WHEN g <> '' THEN g END")


def _group(x: str, pattern: str, n: int) -> str:
    return f"regexp_extract({x}, {text('(?iU)' + pattern)}, {n})"


def _tier_sql(number: str) -> str:
    # a map reads its key once, CASE would copy it into every branch
    tiers = ", ".join(f"{n}D, {text(t)}" for n, t in fixed.HEADCOUNT_TIERS.items())
    return f"try_element_at(map({tiers}), CAST({number} AS double))"


def number_sql(x: str) -> str:
    """Rounded whole number of '1,250', '1.2K', '3M' or '1B'; half values go to even."""
    unit = f"lower(regexp_extract(plain, {text('([kmbKMB])$')}, 1))"
    amount = f"try_cast(CASE WHEN plain RLIKE '[0-9.]$' THEN plain ELSE regexp_replace(plain, {text(r'(?U)\s*[kmbKMB]$')}, '') END AS double)"
    factor = f"coalesce(try_element_at(map('k', 1e3, 'm', 1e6, 'b', 1e9), {unit}), 1e0)"
    shape = text(r"(?U)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*[kmbKMB]?$")
    value = bind(
        f"rint({amount} * {factor})", "v", "CASE WHEN v >= 0 THEN try_cast(v AS decimal(38,0)) END"
    )
    plain = bind(x, "g", f"translate({strip_name_sql('g')}, ',', '')")
    return bind(plain, "plain", f"CASE WHEN plain RLIKE {shape} THEN {value} END")


def _labelled_sql(x: str, pattern: str) -> str:
    """Tier or count label of the number that a pattern finds."""
    label = f"coalesce({_tier_sql('n')}, concat(format_number(n, 0), ' employees'))"
    found = bind(number_sql(_group(x, pattern, 1)), "n", label)
    return f"CASE WHEN {x} RLIKE {text('(?iU)' + pattern)} THEN {found} END"


def headcount_rules_sql(h: str) -> str:
    """The label of stripped text called ``h``, null for text that no rule reads."""
    spelled = text(r"^[+-]?([0-9]{1,15}\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9])?$")
    digits = f"regexp_replace({h}, {text('(?<=[0-9])_(?=[0-9])')}, '')"
    exact = f"CASE WHEN NOT {h} RLIKE '[^-0-9._eE+]' AND {digits} RLIKE {spelled} THEN floor(try_cast({digits} AS double)) END"
    # only one of the two groups takes part in a match, the other is ''
    more = ", ".join(_group(h, fixed.MORE_THAN_PATTERN, n) for n in (1, 2))
    low, high = (_group(h, fixed.RANGE_PATTERN, n) for n in (1, 2))
    before, after, pure = (
        _labelled_sql(h, pattern)
        for pattern in (
            fixed.LABEL_BEFORE_PATTERN,
            fixed.LABEL_AFTER_PATTERN,
            fixed.PURE_NUMBER_PATTERN,
        )
    )
    # a pattern is tried only on text with the marks that it cannot do without
    any_more = f"{h} RLIKE {text('(?i)[+>]|more|over')} AND {h} RLIKE {text('(?iU)' + fixed.MORE_THAN_PATTERN)}"
    any_range = f"{h} RLIKE {text('(?i)[-–—]|to')} AND {h} RLIKE {text('(?iU)' + fixed.RANGE_PATTERN)}"
    number_later = f"{h} RLIKE {text('(?s)[^0-9,].*[0-9,]')}"
    # every rule needs a digit or a comma, so other text skips the patterns
    return f"""CASE WHEN {h} RLIKE '[0-9,]' THEN coalesce({_tier_sql(exact)},
      CASE WHEN {any_more} THEN concat('More than ', {more}, ' employees') END,
      CASE WHEN {any_range} THEN concat({low}, ' - ', {high}, ' employees') END,
      CASE WHEN {number_later} THEN {before} END, {after}, {pure}) END"""


def headcount_sql(h: str) -> str:
    """The label of stripped text called ``h``, else N/A."""
    return f"coalesce({headcount_rules_sql(h)}, {text(fixed.NOT_AVAILABLE)})"


def parse_numeric_suffix(c: Column) -> Column:
    """`parse_numeric_suffix`: '1,250', '1.2K', '3M', '1B' -> rounded whole number."""
    return apply(number_sql("x"), c)


def parse_headcount(c: Column) -> Column:
    """`parse_headcount`: tier, 'More than N', range or count label; else N/A."""
    return apply(headcount_sql("h"), strip(c), "h")


def profile_size_from_text(profile: Column) -> Column:
    """`profile_size_from_text`: the '**Size:** value' line of a profile, else N/A."""
    value = strip(F.regexp_extract(profile, r"(?U)\*\*Size:\*\*\s*([^\n\r]+)", 1))
    unusable = ("", *fixed.PROFILE_SIZE_UNSPECIFIED)
    return let(
        value,
        lambda v: F.when(F.lower(v).isin(*unusable), F.lit(fixed.NOT_AVAILABLE))
        .otherwise(F.coalesce(v, F.lit(fixed.NOT_AVAILABLE))),
    )


def profile_size_from_html(html: Column) -> Column:
    """Headcount printed on a profile page; tags are stripped before parsing."""
    return parse_headcount(F.regexp_replace(html, "(?s)<[^>]*>", " "))


def unspecified_sql(x: str) -> str:
    return f"coalesce(lower({strip_sql(x)}) IN ({texts(fixed.SIZE_UNSPECIFIED)}), true)"


_UNGROUPED = f"CASE WHEN contains(h, ',') THEN regexp_replace(lower(h), {text('(?<=[0-9]),(?=[0-9])')}, '') ELSE lower(h) END"
_PAIR = r"([0-9]+)\s*[-–—to]+\s*([0-9]+)"


def under_100_sql(x: str) -> str:
    """A range decides before '+', '+' before a single number; grouping commas go first."""
    plain, pair = _UNGROUPED, text(_PAIR)
    high = f"try_cast({_filled(f'regexp_extract(d, {pair}, 2)')} AS double)"
    one = f"""CASE WHEN NOT d RLIKE {text(r"[0-9]\+")}
      THEN try_cast({_filled("regexp_extract(d, '([0-9]+)', 1)")} AS double) END"""
    limit = fixed.SMALL_COMPANY
    test = bind(plain, "d", f"coalesce({high} <= {limit}, {one} < {limit})")
    stated = f"CASE WHEN h NOT IN ({texts(fixed.SIZE_NOT_SMALL)}) THEN {test} END"
    return f"coalesce({bind(strip_sql(x), 'h', stated)}, false)"


def size_unspecified(c: Column) -> Column:
    """`size_unspecified`: null or one of the words for 'not mentioned', any case."""
    return apply(unspecified_sql("x"), c)


def size_under_100(c: Column) -> Column:
    """`size_under_100`: fewer than 100 people; digit-grouping commas are ignored."""
    return apply(under_100_sql("x"), c)


def size_eligible(c: Column) -> Column:
    """`size_eligible`: the store gate, unspecified or under 100."""
    return apply(f"({unspecified_sql('x')} OR {under_100_sql('x')})", c)


def with_size_tests(df: DataFrame, small: str, unspecified: str) -> DataFrame:
    """Add the `size_under_100` and `size_unspecified` of number_of_people; each step is a column, so Spark compiles the rules."""
    read = df.withColumn("_people", F.expr(strip_name_sql("number_of_people")))
    plain = F.expr(f"CASE WHEN _people NOT IN ({texts(fixed.SIZE_NOT_SMALL)}) THEN {_UNGROUPED.replace('(h', '(_people')} END")
    numbers = read.withColumn("_plain", plain).withColumns(
        {
            "_high": F.regexp_extract("_plain", _PAIR, 2),
            "_one": F.when(~F.col("_plain").rlike(r"[0-9]\+"), F.regexp_extract("_plain", "([0-9]+)", 1)),
        }
    )
    # '' as a number would throw and catch an exception per row
    high, one = (F.when(F.col(n) != "", F.col(n)).try_cast("double") for n in ("_high", "_one"))
    tests = {
        small: F.coalesce(high <= fixed.SMALL_COMPANY, one < fixed.SMALL_COMPANY, F.lit(False)),
        unspecified: F.coalesce(F.lower("_people").isin(*fixed.SIZE_UNSPECIFIED), F.lit(True)),
    }
    return numbers.withColumns(tests).select(*df.columns, small, unspecified)


def size_bucket(c: Column) -> Column:
    """`size_bucket`: array of overlapping bucket names, by substring."""
    def flag(name: str) -> Column:
        tests = [F.contains(c, F.lit(t)) for t in fixed.SIZE_BUCKETS[name]]
        if name.startswith("Large"):
            tests.append(F.contains(F.lower(c), F.lit(fixed.LARGE_SIZE_PHRASE)))
        return F.when(reduce(lambda a, b: a | b, tests), F.lit(name))

    return F.array_compact(F.array(*[flag(name) for name in fixed.SIZE_BUCKETS]))


def size_struct(c: Column) -> Column:
    """Numeric view of a headcount label: struct(low, high, open_ended, unspecified)."""
    text = F.regexp_replace(F.lower(strip(c)), "(?<=[0-9]),(?=[0-9])", "")
    low = F.regexp_extract(text, "([0-9]+)", 1).try_cast("long")
    high = F.regexp_extract(text, r"([0-9]+)\s*[-–—to]+\s*([0-9]+)", 2).try_cast("long")
    open_ended = F.coalesce(text.rlike(r"[0-9]\+|more than"), F.lit(False))
    return F.struct(
        low.alias("low"),
        F.when(~open_ended, F.coalesce(high, low)).alias("high"),
        open_ended.alias("open_ended"),
        size_unspecified(c).alias("unspecified"),
    )
