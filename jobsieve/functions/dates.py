"""Date and age-label functions (Column -> Column).

Times are TIMESTAMP_NTZ in UTC and ``as_of`` is always explicit, so no result
depends on the session time zone or on the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from jobsieve import fixed
from jobsieve.functions.let import let
from jobsieve.functions.text import strip

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6}\d*)?)?([+-]\d{2}:?\d{2}(:?\d{2})?)?)?$"
)
_DIGITS = "^[0-9]+$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def moment(as_of: Column | str | dt.datetime) -> Column:
    """An as-of time as a TIMESTAMP_NTZ column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def from_unix(seconds: Column) -> Column:
    """Unix seconds or milliseconds as a UTC time; out-of-range numbers give null."""
    number = seconds.try_cast("double")
    divisor = F.when(number > fixed.MILLISECOND_CUTOVER, 1000).otherwise(1)
    return let(number / divisor, _from_seconds)


def _from_seconds(value: Column) -> Column:
    sane = F.when(value.between(-62_135_596_800, 253_402_300_799), value)
    days = F.floor(sane / 86400)
    rest = F.make_dt_interval(
        days.cast("int"), F.lit(0), F.lit(0), (sane - days * 86400).cast("decimal(18,6)")
    )
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + rest


def from_iso(text: Column) -> Column:
    """ISO 8601 text as a UTC time (offsets are applied); anything else gives null."""
    return let(F.replace(text, F.lit("Z"), F.lit("+00:00")), _from_iso)


def _from_iso(iso: Column) -> Column:
    zone = r"[ T].*([+-])(\d{2}):?(\d{2})"
    local = F.regexp_replace(iso, r"([ T].*?)[+-]\d{2}:?\d{2}(:?\d{2})?$", "$1")
    sign = F.when(F.regexp_extract(iso, zone, 1) == "-", -1).otherwise(1)
    offset = F.make_dt_interval(
        F.lit(0),
        F.coalesce(sign * F.regexp_extract(iso, zone, 2).try_cast("int"), F.lit(0)),
        F.coalesce(sign * F.regexp_extract(iso, zone, 3).try_cast("int"), F.lit(0)),
    )
    # text without an offset skips the four patterns that read one
    zoned = iso.rlike(r"[ T].*[+-]\d{2}:?\d{2}")
    time = F.when(zoned, local.try_cast("timestamp_ntz") - offset).otherwise(iso.try_cast("timestamp_ntz"))
    return F.when(iso.rlike(_ISO), time)


def from_source(text: Column) -> Column:
    """Source text as a UTC time: digits are Unix time, the rest is ISO."""
    return let(
        text, lambda t: F.when(t.rlike(_DIGITS), from_unix(t)).otherwise(from_iso(t))
    )


def stamp(ts: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' of a time."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def month_day(ts: Column) -> Column:
    """'Mon D' of a time, independent of locale and zone."""
    names = F.lit(list(fixed.MONTH_NAMES))
    return let(
        ts.cast("date"),
        lambda d: F.concat(
            F.get(names, F.month(d) - 1), F.lit(" "), F.dayofmonth(d).cast("string")
        ),
    )


def _days(ts: Column, as_of: Column) -> Column:
    return F.datediff(as_of.cast("date"), ts.cast("date"))


def _ago(number: Column, unit: str) -> Column:
    return F.concat(number.cast("string"), F.lit(f" {unit} ago"))


def _seconds(ts: Column, as_of: Column) -> Column:
    """Seconds from ts to as_of, with their fraction."""
    gap = as_of.cast("timestamp_ntz") - ts.cast("timestamp_ntz")
    whole = F.extract(F.lit("DAY"), gap).cast("long") * 86400 + F.extract(F.lit("HOUR"), gap) * 3600
    return whole + F.extract(F.lit("MINUTE"), gap) * 60 + F.extract(F.lit("SECOND"), gap)


def age_label(ts: Column, as_of) -> Column:
    """`age_label`: age in calendar days; the future counts as Today."""
    # greatest() skips nulls, so a missing time has to be kept apart
    return let(_days(ts, moment(as_of)), _calendar_label)


def _calendar_label(gap: Column) -> Column:
    days = F.greatest(F.lit(0), gap)
    return (
        F.when(gap.isNull(), F.lit("Unknown"))
        .when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days <= 6, _ago(days, "days"))
        .when(days <= 13, "1 week ago")
        .when(days <= 20, "2 weeks ago")
        .when(days <= 27, "3 weeks ago")
        .when(days <= 60, "1 month ago")
        .otherwise(_ago(F.floor(days / 30), "months"))
    )


def age_label_iso(text: Column, as_of) -> Column:
    """`age_label_iso`: ISO text to an age label; bad text -> Unknown."""
    return age_label(from_iso(text), as_of)


def source_age_label(text: Column, as_of) -> Column:
    """`source_age_label`: ISO or Unix text to an age label; null when unusable."""
    return F.nullif(age_label(from_source(strip(text)), as_of), F.lit("Unknown"))


def age_label_fine(ts: Column, as_of) -> Column:
    """`age_label_fine`: hours on the same date, then days, then months."""
    at = moment(as_of)
    return let(ts, lambda t: _fine_label(t, _days(t, at), F.floor(_seconds(t, at) / 3600)))


def _fine_label(ts: Column, days: Column, hours: Column) -> Column:
    return (
        F.when(ts.isNull(), F.lit("Unknown"))
        .when((days == 0) & (hours < 1), "Today")
        .when((days == 0) & (hours == 1), "1 hour ago")
        .when(days == 0, _ago(hours, "hours"))
        .when(days == 1, "1 day ago")
        .when(days < 30, _ago(days, "days"))
        .when(days < 60, "1 month ago")
        .otherwise(_ago(F.floor(days / 30), "months"))
    )


def extraction_age(as_of) -> Column:
    """`extraction_age`: age label of the run time itself."""
    return age_label(moment(as_of), as_of)


def age_label_ui(ts: Column, as_of) -> Column:
    """`age_label_ui`: compact label of the feed view; missing -> Recently."""
    at = moment(as_of)
    return let(ts, lambda t: let(F.floor(_seconds(t, at) / 60), lambda m: _feed_label(t, m)))


def _feed_label(ts: Column, minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(ts.isNull(), F.lit("Recently"))
        .when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(month_day(ts))
    )


def normalize_published(c: Column) -> Column:
    """`normalize_published`: Unix or ISO text to UTC 'YYYY-MM-DD HH:MM:SS'.

    Text that is neither stays as it is, trimmed; blank text gives null.
    """
    # a valid time that is written so already needs none of the rules
    done = c.rlike(_STAMP) & c.try_cast("timestamp_ntz").isNotNull()
    rules = let(
        strip(c), lambda t: F.coalesce(stamp(from_source(t)), F.nullif(t, F.lit("")))
    )
    return F.when(done, c).otherwise(rules)


def posted_label(published: Column, stored: Column, first_seen: Column, as_of) -> Column:
    """`posted_label`: published age, else the stored label, else the first-seen age."""
    usable = ~strip(stored).isin(*fixed.STORED_LABEL_EMPTY)
    return (
        F.when(published != "", age_label_fine(from_source(published), as_of))
        .when(usable, stored)
        .otherwise(age_label_fine(first_seen, as_of))
    )


def is_new_today(first_seen: Column, as_of) -> Column:
    """`is_new_today`: first seen on the as-of date; missing -> false."""
    return F.coalesce(first_seen.cast("date") == moment(as_of).cast("date"), F.lit(False))


def date_tab(first_seen: Column) -> Column:
    """`date_tab`: 'Mon D' of the first-seen time, else Other."""
    return F.coalesce(month_day(first_seen), F.lit("Other"))
