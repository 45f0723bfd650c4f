"""Dates and times: ordinals, epochs, truncation, tags and time zones. Naive times are TIMESTAMP_NTZ or UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 0001-01-01 (day 1) to 1970-01-01.
UNIX_ORDINAL = 719163
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "d MMM yyyy H:mm", "H:mm, d MMMM yyyy", "MMMM d, yyyy H:mm", "yyyy-MM-dd")
RESOLUTIONS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
#: Common abbreviations of zones.
ZONES = {"UTC": "UTC", "GMT": "UTC", "Z": "UTC", "EST": "America/New_York", "EDT": "America/New_York", "CST": "America/Chicago", "CDT": "America/Chicago", "MST": "America/Denver", "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "AKST": "America/Anchorage", "HST": "Pacific/Honolulu", "HAST": "Pacific/Honolulu", "AST": "America/Halifax", "CET": "Europe/Paris", "CEST": "Europe/Paris", "EET": "Europe/Helsinki", "BST": "Europe/London", "WET": "Europe/Lisbon", "MSK": "Europe/Moscow", "IST": "Asia/Kolkata", "JST": "Asia/Tokyo", "KST": "Asia/Seoul", "AEST": "Australia/Sydney", "NZST": "Pacific/Auckland"}
#: Hours from UTC of abbreviations and of military letters.
ZONE_HOURS = {"UTC": 0.0, "GMT": 0.0, "EST": -5.0, "EDT": -4.0, "CST": -6.0, "CDT": -5.0, "MST": -7.0, "MDT": -6.0, "PST": -8.0, "PDT": -7.0, "AKST": -9.0, "HST": -10.0, "AST": -4.0, "CET": 1.0, "CEST": 2.0, "EET": 2.0, "MSK": 3.0, "IST": 5.5, "JST": 9.0, "KST": 9.0, "AEST": 10.0, "NZST": 12.0} | {c: float(i + 1) for i, c in enumerate("ABCDEFGHIKLM")} | {c: -float(i + 1) for i, c in enumerate("NOPQRSTUVWXY")} | {"Z": 0.0}
EARLIEST, LATEST = "1677-09-22 00:12:44", "2262-04-11 23:47:16"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _tried(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def to_date(value: Column, formats: tuple[str, ...] = DATE_FORMATS + TIME_FORMATS) -> Column:
    """A date from a string in any of the formats; 1970-01-01 where there is none."""
    s = F.trim(value.cast("string"))
    return F.coalesce(s.try_cast("date"), _tried(s, formats).cast("date"), F.lit("1970-01-01").cast("date"))


def to_datetime(value: Column, formats: tuple[str, ...] = TIME_FORMATS + DATE_FORMATS) -> Column:
    """A timestamp from a string in any of the formats, or from a number of days since 0001-01-01."""
    s = F.trim(value.cast("string"))
    return F.coalesce(s.try_cast("timestamp"), _tried(s, formats), from_ordinal(s.try_cast("double")))


def time_of_day(text: Column) -> Column:
    """Seconds since midnight of a string such as '9:15' or '09:15:30', else null."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([AaPp])[Mm])?$", i), F.lit(""))
    h, m, s, half = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0)), F.lower(part(4))
    h = F.when(half == "p", F.pmod(h, F.lit(12)) + 12).when(half == "a", F.pmod(h, F.lit(12))).otherwise(h)
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def seconds_of_day(ts: Column) -> Column:
    return F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts), F.lit(0))


def quantize(ts: Column, resolution: int = 3) -> Column:
    """Only the first fields of a time: 1 keeps the year, 6 all but fractions of seconds."""
    return F.date_trunc(RESOLUTIONS[resolution - 1], ts)


def ordinal(date: Column) -> Column:
    """Days since 0001-01-01, which is 1."""
    return F.unix_date(date.cast("date")) + UNIX_ORDINAL


def from_day_ordinal(days: Column) -> Column:
    return F.date_from_unix_date((days - UNIX_ORDINAL).cast("int"))


def ordinal_float(ts: Column) -> Column:
    """Days and part of a day since 0001-01-01."""
    return UNIX_ORDINAL + _micros(ts) / F.lit(86_400e6)


def from_ordinal(days: Column) -> Column:
    """The time that ordinal_float gives, to ten microseconds (what a double holds); null for NaN and infinities."""
    usable = F.abs(days) < 4e6
    return F.when(usable, F.timestamp_micros(F.round((F.when(usable, days) - UNIX_ORDINAL) * 8_640e6).cast("bigint") * 10))


def days_since(ts: Column, start: Column) -> Column:
    return (_micros(ts) - _micros(start)) / F.lit(86_400e6)


def time_tag(ts: Column, separator: str = "-", resolution: int = 6, filled: bool = True) -> Column:
    """Year, month and so on, joined, with leading zeros or without."""
    parts = ("yyyy", "MM", "dd", "HH", "mm", "ss") if filled else ("y", "M", "d", "H", "m", "s")
    return F.concat_ws(separator, *[F.date_format(ts, p) for p in parts[:resolution]])


def is_american_date(text: Column, need_year: bool = True) -> Column:
    """Whether a string is month/day/year (or month/day)."""
    parts = F.split(text, "/")
    m, d, y = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    ok = m.between(1, 12) & d.between(1, 31)
    ok = ok & (F.size(parts) == 3) & y.isNotNull() if need_year else ok & F.size(parts).between(2, 3)
    return F.coalesce(ok, F.lit(False))


def to_utc(ts: Column, zone: str = "UTC") -> Column:
    """A naive time of a zone (or its abbreviation) as UTC."""
    return F.to_utc_timestamp(ts, ZONES.get(zone.upper(), zone))


def market_close(ts: Column) -> Column:
    """Times at midnight become 16 h."""
    return F.when(ts == F.date_trunc("DAY", ts), ts + F.expr("INTERVAL 16 HOURS")).otherwise(ts)


def wiki_datetime(text: Column) -> Column:
    """Times of an encyclopedia's signatures: 'at' and a missing colon are mended."""
    s = F.regexp_replace(text, r"(?i)\bat\b|\(utc\)", "")
    s = F.regexp_replace(s, r"\b([01]?\d|2[0-3])[ :]+([0-5]\d)(?=\s*,|\s*$)", "$1:$2")
    return _tried(F.trim(F.regexp_replace(s, r"\s+", " ")), ("H:mm, d MMMM yyyy", "d MMMM yyyy H:mm", *TIME_FORMATS))


def clip(ts: Column) -> Column:
    """Within the range of 64-bit nanoseconds."""
    low, high = F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")
    return F.when(ts.isNotNull(), F.least(F.greatest(ts.cast("timestamp"), low), high))


def epoch_seconds(year: Column) -> Column:
    """Seconds from 1970 to the first of January of a year."""
    return F.unix_date(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1))).cast("bigint") * 86_400


def epoch_milliseconds(year: Column) -> Column:
    return epoch_seconds(year) * 1000


def epoch_datetime(epoch: Column) -> Column:
    """A year if the number is small (under 10,000), else seconds since 1970, as a time."""
    small = epoch.between(1, 9999)
    return F.when(small, F.make_date(F.when(small, epoch).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")).otherwise(F.timestamp_seconds(epoch))


def seconds(ts: Column, epoch: Column | None = None) -> Column:
    """Whole seconds since 1970, less an epoch in seconds."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return s if epoch is None else s - epoch


def milliseconds(ts: Column, epoch: Column | None = None) -> Column:
    """Whole seconds since 1970 in milliseconds, less an epoch in seconds."""
    return seconds(ts, epoch) * 1000


def from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s)


def century_shift(a: Column, b: Column) -> Column:
    """Whole centuries between two dates' years where they are more than 70 years apart, else 0."""
    gap = F.year(a) - F.year(b)
    return F.when(F.abs(gap) > 70, (F.round(gap / 100.0) * 100).cast("int")).otherwise(F.lit(0))
