"""Records, columns, maps and matrices turned into one another. Row order is a column wherever it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings


def aligned_records(frames: list[DataFrame], filler=None) -> DataFrame:
    """Records of differing columns in one table; missing cells get the filler."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if filler is None else out.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(str(filler))).alias(c) if out.schema[c].dataType.simpleString() == "string" else F.coalesce(F.col(f"`{c}`"), F.lit(filler)).alias(c) for c in out.columns])


def named(table: DataFrame, header: str | list[str]) -> DataFrame:
    """table with column names from a list, or a string with tabs, commas or spaces between them."""
    if isinstance(header, str):
        separator = next((s for s in ("\t", ",", " ") if s in header), None)
        header = [h.strip() for h in (header.split(separator) if separator else [header])]
    return table.toDF(*header)


def selected_sorted(table: DataFrame, excluded: tuple[str, ...] = ("id",)) -> DataFrame:
    """All columns but these, in order of their names."""
    return table.select(*[f"`{c}`" for c in sorted(set(table.columns) - set(excluded))])


def transposed_ragged(rows: DataFrame, position: str, row: str) -> DataFrame:
    """From rows of arrays, columns of arrays: j and values; values of short rows are left out, so later ones move up."""
    cells = rows.select(F.col(position).alias("i"), F.posexplode(row).alias("j", "v"))
    return cells.groupBy("j").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("values"))


def transposed_matrix(matrix: Column, filler=None) -> Column:
    """An array of arrays transposed; short rows are filled."""
    width = F.aggregate(matrix, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    get = lambda r, j: F.coalesce(F.try_element_at(r, j), F.lit(filler)) if filler is not None else F.try_element_at(r, j)
    return F.when(width > 0, F.transform(F.sequence(F.lit(1), width), lambda j: F.transform(matrix, lambda r: get(r, j)))).otherwise(F.slice(matrix, 1, 0))


def floats(matrix: Column) -> Column:
    """Every cell of an array of arrays of strings as a double."""
    from ..functions.coerce import to_float

    return F.transform(matrix, lambda r: F.transform(r, lambda c: to_float(c)))


def consolidated_stats(table: DataFrame, stat: str, separator: str = ", ") -> DataFrame:
    """key (all other columns by name, joined) and the statistic."""
    others = sorted(c for c in table.columns if c != stat)
    return table.select(F.concat_ws(separator, *[F.col(f"`{c}`").cast("string") for c in others]).alias("key"), F.col(stat).alias("stat"))


def unpivoted(table: DataFrame, keys: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return table.unpivot(keys, values, name, value)


def flattened_times(table: DataFrame, date: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """From a row for each date and a column for each time of day: ts and value (after the columns to keep). Columns that aren't times are left out."""
    from ..functions.dates import time_of_day, to_date

    date = date or next(c for c in table.columns if "date" in c.lower())
    import re

    times = [c for c in table.columns if c != date and re.fullmatch(r"\s*\d{1,2}:\d{2}(:\d{2})?\s*([AaPp][Mm])?\s*", c)]
    long = table.select(*keep, F.col(f"`{date}`").cast("string").alias("day"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in times]).unpivot([*keep, "day"], times, "tod", "value")
    return long.select(*keep, (F.unix_seconds(to_date(F.col("day")).cast("timestamp")) + time_of_day(F.col("tod"))).alias("s"), "value").select(*keep, F.timestamp_seconds("s").alias("ts"), "value")


def padded(items: Column, n: int) -> Column:
    """An array of at least n items; the last is repeated."""
    return F.when(F.size(items) >= n, items).otherwise(F.concat(items, F.array_repeat(F.element_at(items, -1), F.lit(n) - F.size(items))))


def nested_item(items: Column, depth: int = 1, place: int = 0) -> Column:
    """The item at a place, of the item at that place and so on; null where there is none."""
    out = items
    for _ in range(depth):
        out = F.try_element_at(out, F.lit(place + 1))
    return out


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def joined(items: Column, separator: str | None = None) -> Column:
    return items if separator is None else F.array_join(items, separator)


def inverted_map(m: Column) -> Column:
    """Values to keys; of equal values the last key stays."""
    pairs = F.reverse(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    once = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def inverted_lists(table: DataFrame, key: str, values: str) -> DataFrame:
    """value and key for a table of keys and arrays; of several keys the highest."""
    return table.select(F.col(key).alias("key"), F.explode(values).alias("value")).groupBy("value").agg(F.max("key").alias("key"))


def key_of(m: Column, value: Column, default=None) -> Column:
    """The first key with this value."""
    return F.coalesce(F.try_element_at(F.map_keys(F.map_filter(m, lambda k, v: v == value)), F.lit(1)), F.lit(default))


def merged_maps(a: Column, b: Column, take_new: bool = True) -> Column:
    """Both maps' entries; of keys in both, b's value (or a's)."""
    pick = (lambda k, x, y: F.coalesce(y, x)) if take_new else (lambda k, x, y: F.coalesce(x, y))
    return F.map_zip_with(a, b, pick)


def merged_nested(a: Column, b: Column, take_new: bool = True) -> Column:
    """Maps of maps, merged at both levels."""
    empty = lambda m: F.map_filter(m, lambda k, v: F.lit(False))
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merged_maps(F.coalesce(x, empty(y)), F.coalesce(y, empty(x)), take_new)))


def stripped_keys(m: Column, drop_blank: bool = True) -> Column:
    """Keys without space at the edges; blank ones and 'None' go."""
    out = F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.map_filter(out, lambda k, v: ~k.isin("", "None")) if drop_blank else out


def simplified_params(m: Column, drop: tuple[str, ...] = ()) -> Column:
    """Query parameters without empty ones and these; times at midnight are dates."""
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & ~k.isin("", *drop))
    return F.transform_values(kept, lambda k, v: F.regexp_replace(v, "[ T]00:00:00$", ""))


def cleaned(table: DataFrame, zone: str = "UTC", drop: tuple[str, ...] = ("_state",)) -> DataFrame:
    """Strings without space at the edges, naive times as UTC, and without these columns."""
    kinds = dict(table.dtypes)

    def clean(c: str) -> Column:
        col = F.col(f"`{c}`")
        if kinds[c] == "string":
            return F.trim(col).alias(c)
        return F.to_utc_timestamp(col, zone).alias(c) if kinds[c] == "timestamp_ntz" else col.alias(c)

    return table.select(*[clean(c) for c in table.columns if c not in drop])


def quantified(table: DataFrame, places: int | None = None) -> DataFrame:
    """Times as seconds since 1970, strings that are numbers as doubles (others null), and rounded."""
    kinds = dict(cleaned(table).dtypes)

    def number(c: str) -> Column:
        col = F.col(f"`{c}`")
        if kinds[c].startswith("timestamp"):
            col = F.unix_micros(col.cast("timestamp")) / F.lit(1e6)
        elif kinds[c] == "date":
            col = F.unix_date(col) * 86400.0
        elif kinds[c] == "string":
            col = col.try_cast("double")
        elif kinds[c] == "boolean":
            col = col.cast("int")
        return (F.round(col, places) if places is not None and kinds[c] != "boolean" else col).alias(c)

    return cleaned(table).select(*[number(c) for c in cleaned(table).columns])


def representation(kind: str, *fields: Column) -> Column:
    """Kind('a', 'b') from the fields' values."""
    return F.concat(F.lit(f"{kind}("), F.array_join(F.array(*[F.concat(F.lit("'"), F.coalesce(f.cast("string"), F.lit("None")), F.lit("'")) for f in fields[:10]]), ", "), F.lit(")"))


def json_row(table: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON; times are whole seconds since 1970."""
    kinds = dict(table.dtypes)
    fields = [F.unix_seconds(F.col(f"`{c}`").cast("timestamp")).alias(c) if kinds[c].startswith("timestamp") else F.col(f"`{c}`") for c in table.columns]
    return table.select(F.to_json(F.struct(*fields)).alias(name))


def delimited_lines(table: DataFrame, separator: str = ",", max_columns: int | None = None, name: str = "line") -> DataFrame:
    """Each row as a line, unquoted."""
    return table.select(F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns[:max_columns]]).alias(name))


def markdown_lines(table: DataFrame, name: str = "line") -> DataFrame:
    """Each row as a line of a Markdown table."""
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]), F.lit(" |")).alias(name))


def markdown_header(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("-" * max(3, len(c)) for c in columns) + " |"]


def normalized_columns(table: DataFrame) -> DataFrame:
    """Columns named by identifiers; repeats get a number."""
    import re

    out: list[str] = []
    for c in table.columns:
        base = re.sub("[^a-z0-9]+", "_", c.strip().lower()) or "column"
        n, name = 1, base
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return table.toDF(*out)


def numbered(table: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Row numbers from 0 in an order, by a range partitioning and prefix sums of the partitions' sizes: no task sees all rows.

    The partitions are settled first: worked out once more for their sizes, without the other columns, they would have
    other bounds, and adaptive execution would merge others of them."""
    from ..sources.folders import settled

    ranged = settled(table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__p").count()
    # A row for each partition.
    bases = sizes.withColumn("__base", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__base")
    inside = F.col("__m").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(bases), "__p").withColumn(name, F.col("__base") + inside).drop("__p", "__m", "__base")


def records(spark: SparkSession, rows: list[dict] | list[list], columns: list[str] | None = None) -> DataFrame:
    """A table from a few rows in the program; rows without any value are left out."""
    if rows and isinstance(rows[0], dict):
        names = list(dict.fromkeys(k for r in rows for k in r))
        rows = [[r.get(k) for k in names] for r in rows]
    else:
        names = columns or [str(i) for i in range(max(map(len, rows), default=0))]
    return spark.createDataFrame([tuple([*r, *[None] * (len(names) - len(r))]) for r in rows], names).dropna("all")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "strings")]
