"""Numeric scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, infinite: float | None = math.inf) -> Column:
    """a / b; infinite (without sign) where b is 0; the operand that is there where the other is null."""
    return F.when(b.isNull(), a).when(a.isNull(), b).when(b == 0, F.lit(infinite).cast("double")).otherwise(F.try_divide(a, b))


def round_significant(x: Column, digits: int = 3) -> Column:
    """Rounded to significant digits; with none or fewer, the next power of ten above, times ten for each digit less."""
    if digits <= 0:
        return F.when((x == 0) | x.isNull() | F.isnan(x.cast("double")), x.cast("double")).otherwise(power_of_ten_above(x) * F.lit(10.0 ** -digits) * F.signum(x))
    e = F.floor(F.log10(F.abs(x)))
    return F.when((x == 0) | x.isNull() | F.isnan(x.cast("double")), x.cast("double")).otherwise(F.round(x / F.pow(F.lit(10.0), e - (digits - 1)), 0) * F.pow(F.lit(10.0), e - (digits - 1)))


def round_place(x: Column, places: int = 0) -> Column:
    """Rounded to decimal places; negative ones are left of the point."""
    return F.round(x, places)


def power_of_ten_above(x: Column) -> Column:
    return F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(x))))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number (1, 1, 2, ...), null for n < 1 and beyond 92."""
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    steps = F.when(n.between(2, 92), F.sequence(F.lit(2), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    last = F.aggregate(steps, start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["b"])
    return F.when(n.between(1, 92), last)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation from the four counts; null where a margin is empty."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def chi_squared(phi: Column, n: Column) -> Column:
    return F.coalesce(phi * phi * n, F.lit(0.0))


def chi(phi: Column, n: Column) -> Column:
    return F.sqrt(chi_squared(phi, n))


def chi_squared_of_counts(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return chi_squared(mcc(tp, tn, fp, fn), tp + tn + fp + fn)


def opposite_label(label):
    """The label for the other class: None and booleans flip, 0 and 1 flip, negative numbers lose their sign, others rise by one; words by a table, else 'P'."""
    pairs = {"n": "p", "no": "yes", "false": "true", "f": "t", "negative": "positive", "neg": "pos", "absent": "present", "bad": "good", "ham": "spam", "healthy": "sick", "off": "on", "loss": "win", "fail": "pass"}
    if label is None:
        return True
    if isinstance(label, bool):
        return not label
    if isinstance(label, (int, float)):
        return 1 - label if label in (0, 1) else -label if label < 0 else label + 1
    found = pairs.get(str(label).lower())
    if found is None:
        back = {v: k for k, v in pairs.items()}.get(str(label).lower())
        found = back if back is not None else "p"
    return found.upper() if str(label).isupper() or found == "p" and str(label).lower() not in pairs else found.title() if str(label).istitle() else found
