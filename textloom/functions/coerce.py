"""Tolerant conversions of messy strings: what can't be converted gives a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import replace

NULL_WORDS = ("", "0", "None", "null", "'", *(f"0.{'0' * i}" for i in range(10)))
BLANK_WORDS = ("", " ", "-", "--", "none", "null", "nan", "n/a", "na", "unknown")
TRUE_WORDS, FALSE_WORDS = ("1", "1.0", "true", "t", "yes", "y"), ("0", "0.0", "false", "f", "no", "n")
COUNT_NAMES = ("count", "cnt", "number", "num", "n", "total", "frequency", "freq", "hist")


def _digits(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def null_if_blank(text: Column, words: tuple[str, ...] = BLANK_WORDS) -> Column:
    """Null where the string, without space at the edges and in lower case, is one of the words."""
    return F.when(F.lower(F.trim(text)).isin(*words), None).otherwise(text)


def to_bool(text: Column) -> Column:
    s = F.lower(F.trim(text.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_type(text: Column, kinds: list[str], default: Column | None = None, empty: Column | None = None) -> Column:
    """The first of the casts that works; empty for blank or null strings."""
    tried = F.coalesce(*[F.trim(text).try_cast(k) for k in kinds], default if default is not None else F.lit(None))
    return F.when(text.isNull() | (F.trim(text) == ""), empty if empty is not None else F.lit(None)).otherwise(tried)


def first_digits(text: Column, default: int = 0) -> Column:
    """The integer that the string begins with, after any signs."""
    return F.coalesce(_digits(text.cast("string"), r"^[\s+-]*([0-9]+)").try_cast("bigint"), F.lit(default).cast("bigint"))


def int_pair(text: Column) -> Column:
    """(first, second): the integers beside the first run of other characters; (0, null) where it begins with none."""
    s = F.trim(text.cast("string"))
    first = _digits(s, "^([0-9]+)").try_cast("bigint")
    second = F.when(first.isNotNull(), _digits(s, "^[0-9]+[^0-9]+([0-9]+)").try_cast("bigint"))
    return F.struct(F.coalesce(first, F.lit(0).cast("bigint")).alias("first"), second.alias("second"))


def postal_code(text: Column, lengths: tuple[int, ...] = (2, 3, 5, 10)) -> Column:
    """A US postal code of one of the lengths, '' where there is none. Four digits get a 0 in front."""
    pair = int_pair(text)
    z = F.when(pair["first"] == 0, F.lit("")).otherwise(pair["first"].cast("string"))
    more = F.when(F.coalesce(pair["second"], F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit("-"), pair["second"].cast("string")))
    z = F.when(F.length(z) == 4, F.concat(F.lit("0"), z)).otherwise(z)
    whole = F.concat(z, more)
    return F.when(F.length(whole).isin(*lengths), whole).when(F.length(z).isin(*{min(n, 5) for n in lengths}), z).otherwise(F.lit(""))


def scientific(text: Column) -> Column:
    """A string that a cast to double takes: signs kept, sums of terms added up, 'x 10^' as e."""
    s = F.replace(text, F.lit(","), F.lit(""))
    s = replace(replace(s, "^[^0-9+-]+", ""), r"[^0-9]+\z", "")
    parts = F.split(s, P.EXPONENT, 3)
    terms = F.regexp_extract_all(replace(F.element_at(parts, 1), "[^.0-9+-]+", ""), F.lit(r"[+-]?[0-9]*[.]?[0-9]+|[+-]?[0-9]+[.]?"), F.lit(0))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(t.try_cast("double"), F.lit(0.0)))
    plain = F.when(F.size(terms) == 1, replace(F.element_at(terms, 1), "^[+]", "")).otherwise(F.when(total == F.floor(total), total.cast("bigint").cast("string")).otherwise(total.cast("string")))
    base = F.when(F.size(terms) > 0, plain)
    power = replace(F.try_element_at(parts, F.lit(2)), "[^.0-9+-]+", "")
    return F.when(power.isNull() | (power == ""), base).otherwise(F.concat(F.coalesce(base, F.lit("1")), F.lit("e"), power))


def to_float(text: Column, default: float | None = None) -> Column:
    """A double from strings such as '12,345', '$42.42', '1+2' or '1.2 x 10^34'."""
    s = F.replace(text.cast("string"), F.lit(","), F.lit(""))
    return F.coalesce(F.trim(s).try_cast("double"), scientific(text.cast("string")).try_cast("double"), F.lit(default).cast("double"))


def to_int(text: Column, default: int | None = None) -> Column:
    """A bigint, cut towards zero."""
    s = F.trim(F.replace(text.cast("string"), F.lit(","), F.lit("")))
    return F.coalesce(s.try_cast("bigint"), to_float(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def to_code(text: Column) -> Column:
    """A bigint if the string is a number, else the code of its first letter in lower case."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.ascii(F.lower(F.left(text, F.lit(1)))).cast("bigint"))


def year(text: Column) -> Column:
    """A year of four digits; 0 to 69 count from 2000, 70 to 99 from 1900."""
    y = replace(text.cast("string"), "[^0-9]+", "").try_cast("int")
    return F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)


def financial(text: Column) -> Column:
    """An amount such as '$1,200', '3.5k', '2M' or '12 percent' (0.12)."""
    s = replace(F.trim(text), "(?i)flat|[ ,\"'\t\n\r$]", "")
    share = s.rlike("(?i)(percent|pcnt|pct|pt|%)$")
    s = replace(s, "(?i)(percent|pcnt|pct|pt|%)$", "")
    scale = F.when(s.endswith("k"), 1e3).when(s.endswith("M"), 1e6).otherwise(1.0)
    return replace(s, "[kM]$", "").try_cast("double") * scale * F.when(share, 0.01).otherwise(1.0)


def column_to_date(name: Column) -> Column:
    """The first of the month in labels such as '10_2011', 'apr_10' or '10-Apr'; years are literal."""
    a, b = F.regexp_extract(name, r"^([0-9A-Za-z]+)[^0-9A-Za-z]([0-9A-Za-z]+)", 1), F.regexp_extract(name, r"^([0-9A-Za-z]+)[^0-9A-Za-z]([0-9A-Za-z]+)", 2)

    def month(s: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m) for m in P.MONTHS]), F.lower(s))
        return F.when(at > 0, at.cast("int"))

    ai, bi = a.try_cast("int"), b.try_cast("int")
    y = F.when(month(b).isNotNull() & ai.isNotNull(), ai).when(month(a).isNotNull() & bi.isNotNull(), bi).when(ai.between(1, 12) & bi.between(1, 2100), bi).when(bi.between(1, 12) & ai.between(1, 2100), ai)
    m = F.when(month(b).isNotNull() & ai.isNotNull(), month(b)).when(month(a).isNotNull() & bi.isNotNull(), month(a)).when(ai.between(1, 12) & bi.between(1, 2100), ai).when(bi.between(1, 12) & ai.between(1, 2100), bi)
    return F.when(y.between(1, 2100) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def count_label(columns: list[str]) -> str | None:
    """The first column whose name says that it holds counts."""
    for name in COUNT_NAMES:
        for c in columns:
            if c == name or c.lower() == name:
                return c
    return None
