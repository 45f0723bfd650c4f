"""Windows over sequences and time series.

With partition columns each sequence is a window partition. Without them the one
sequence is numbered over a range partitioning, and places are joined, so that
no task sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reshape import numbered


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _placed(table: DataFrame, order: list[str]) -> DataFrame:
    """table with __r, the place in an order."""
    return numbered(table, [F.col(o) for o in order], "__r")


def _at(rows: DataFrame, value: str, lag, name: str) -> DataFrame:
    """The value lag places before, with __hit where there is one."""
    other = rows.select((F.col("__r") + lag).alias("__r"), F.col(value).alias(name), F.lit(True).alias("__hit"))
    return rows.join(other, "__r", "left")


def sliding(table: DataFrame, value: str, order: list[str], n: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with window: the value and the n - 1 after it; rows without so many are left out."""
    if by:
        w = _over(list(by), order).rowsBetween(0, n - 1)
        return table.withColumn("window", F.collect_list(value).over(w)).where(F.size("window") == n)
    rows = _placed(table, order)
    parts = rows.select(F.explode(F.sequence(F.col("__r") - (n - 1), F.col("__r"))).alias("__r"), F.struct(F.col("__r").alias("i"), F.col(value).alias("v")).alias("x"))
    windows = parts.groupBy("__r").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("window")).where(F.size("window") == n)
    return rows.join(windows, "__r").drop("__r")


def batches(table: DataFrame, value: str, order: list[str], size: int, start: int = 0) -> DataFrame:
    """batch (from 0) and items: successive values in an order; the last batch may be short. Batches before start are skipped."""
    rows = numbered(table, [F.col(o) for o in order])
    own = rows.withColumn("batch", F.floor(F.col("row_id") / size)).where(F.col("batch") >= start)
    return own.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def lagged(table: DataFrame, value: str, order: list[str], lag: int = 1, pad=None, by: tuple[str, ...] = (), name: str = "lagged") -> DataFrame:
    """The value lag rows before (after, if negative), with pad where there is none."""
    if not by:
        rows = _at(_placed(table, order).withColumnRenamed(value, "__v"), "__v", lag, "__lagged").withColumnRenamed("__v", value)
        return rows.withColumn(name, F.when(F.col("__hit"), F.col("__lagged")).otherwise(F.lit(pad))).drop("__r", "__lagged", "__hit")
    w = _over(list(by), order)
    column = F.lag(value, lag, pad).over(w) if lag >= 0 else F.lead(value, -lag, pad).over(w)
    return table.withColumn(name, column)


def lagged_circular(table: DataFrame, value: str, order: list[str], lag: int = 1, by: tuple[str, ...] = (), name: str = "lagged") -> DataFrame:
    """The value lag rows before, from the end again at the beginning."""
    if by:
        w = _over(list(by), order)
        rows = table.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    else:
        placed = _placed(table, order)
        rows = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("__n"))))  # one row
    other = rows.select(*by, F.pmod(F.col("__r") + lag, F.col("__n")).alias("__r"), F.col(value).alias(name))
    return rows.join(other, [*by, "__r"]).drop("__r", "__n")


def circular(items: Column, lag: int = 1) -> Column:
    """An array turned by lag places."""
    n = F.size(items)
    k = F.pmod(F.lit(lag), n)
    return F.when(n > 0, F.concat(F.slice(items, n - k + 1, k), F.slice(items, F.lit(1), n - k))).otherwise(items)


def shifted(items: Column, lag: int = 1, pad=None) -> Column:
    """An array moved by lag places, of the same length, with pad where nothing comes in."""
    n = abs(lag)
    fill = F.array_repeat(F.lit(pad), F.least(F.lit(n), F.size(items)))
    keep = F.greatest(F.size(items) - n, F.lit(0))
    return F.concat(fill, F.slice(items, F.lit(1), keep)) if lag >= 0 else F.concat(F.slice(items, F.lit(n + 1), keep), fill)


def lagged_series(series: DataFrame, lags: dict[int, int], pads: dict[int, float] | None = None, series_id: str = "series", order: str = "pos", value: str = "v") -> DataFrame:
    """Each series shifted by its own lag; those without one stay. pads: what comes in (null otherwise)."""
    w = Window.partitionBy(series_id).orderBy(order)
    out = F.col(value)
    for s, k in lags.items():
        pad = (pads or {}).get(s)
        moved = F.lag(value, k, pad).over(w) if k >= 0 else F.lead(value, -k, pad).over(w)
        out = F.when(F.col(series_id) == s, moved).otherwise(out)
    return series.withColumn("lagged", out)


def clipped(series: DataFrame, time: str, low=None, high=None) -> DataFrame:
    """Rows whose time is from low to high; an open side has no bound."""
    out = series
    if low is not None:
        out = out.where(F.col(time) >= low)
    return out if high is None else out.where(F.col(time) <= high)


def adaptive_density(table: DataFrame, x: str, window: int = 10, probability: bool = True, edge: float = 1.0) -> DataFrame:
    """x (0 to 1) and density from order statistics: the share of points in a window over its width; both edges are added."""
    bounds = table.where(F.col(x).isNotNull()).agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b"), F.count(x).alias("n"))
    r = bounds.first()
    if not r.n or r.a == r.b:
        return table.select(F.lit(0.0).alias("x"), F.lit(1.0).alias("density")).limit(0)
    w = max(1, min(window, int(r.n / 1.5))) + 1
    u = table.where(F.col(x).isNotNull()).select(((F.col(x) - r.a) / (r.b - r.a)).alias("u"))
    rows = _placed(u, ["u"])
    ahead = lambda k, name: rows.select((F.col("__r") - k).alias("__r"), F.col("u").alias(name))
    wide = rows.join(ahead(w // 2, "x"), "__r").join(ahead(w - 1, "last"), "__r").select("x", (F.col("last") - F.col("u")).alias("d"))
    inner = wide.select("x", F.try_divide(F.lit((w - 1) / (r.n - 1)), F.col("d")).alias("density"))
    if not probability:
        inner = inner.withColumn("density", F.col("density") * r.n)
    ends = inner.agg(F.min_by("density", "x").alias("first"), F.max_by("density", "x").alias("last"))
    edges = ends.select(F.explode(F.array(F.struct(F.lit(0.0).alias("x"), (F.col("first") * edge).alias("density")), F.struct(F.lit(1.0).alias("x"), (F.col("last") * edge).alias("density")))).alias("e")).select("e.*")
    return inner.union(edges)


def resampled(series: DataFrame, time: str, value: str, step: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """A regular grid from the first to the last time of each series, interpolated linearly between samples.

    Each sample makes the grid points up to the next one, so no join is needed. Equal times are averaged."""
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    own = series.select(*by, seconds.alias("__t"), F.col(value).cast("double").alias("__v")).groupBy(*by, "__t").agg(F.avg("__v").alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t")
    period = int(series.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00' + INTERVAL {step})").first()[0]) - int(series.sparkSession.sql("SELECT unix_micros(timestamp'1970-01-01 00:00:00')").first()[0])
    first = F.min("__t").over(Window.partitionBy(*by))
    near = own.withColumn("__first", first).withColumn("__t1", F.lead("__t").over(w)).withColumn("__v1", F.lead("__v").over(w))
    # Grid numbers at or after this sample and before the next; the last sample has only its own.
    low = F.ceil((F.col("__t") - F.col("__first")) / period).cast("bigint")
    high = F.when(F.col("__t1").isNull(), F.floor((F.col("__t") - F.col("__first")) / period).cast("bigint")).otherwise(F.ceil((F.col("__t1") - F.col("__first")) / period).cast("bigint") - 1)
    grid = near.withColumn("__low", low).withColumn("__high", high).where("__low <= __high").withColumn("__k", F.explode(F.sequence("__low", "__high")))
    at = F.col("__first") + F.col("__k") * period
    between = F.col("__v") + F.coalesce((F.col("__v1") - F.col("__v")) * ((at - F.col("__t")) / (F.col("__t1") - F.col("__t"))), F.lit(0.0))
    return grid.select(*by, F.timestamp_micros(at).alias("ts"), between.alias("value"))
