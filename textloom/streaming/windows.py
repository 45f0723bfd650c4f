"""Event-time windows on streams, each the twin of a batch transform: the same function takes either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, like: DataFrame | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; like gives the schema."""
    schema = (like if like is not None else spark.read.parquet(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """With ts as an instant, and a watermark if the frame is a stream."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late and events.isStreaming else out


def tumbling(events: DataFrame, size: str = "1 day", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """start, keys, n and total by windows that don't overlap."""
    return _counted(timed(events, ts), F.window(ts, size), keys, value)


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    return _counted(timed(events, ts), F.window(ts, size, step), keys, value)


def sessions(events: DataFrame, gap: str = "3 hours", keys: tuple[str, ...] = ("user_id",), ts: str = "ts", value: str = "value", late: str | None = "1 hour") -> DataFrame:
    """start, end, keys, n and total of runs of events that are less than gap apart. A stream drops events later than late, in complete mode too; None keeps all."""
    w = F.session_window(ts, gap)
    out = timed(events, ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def _counted(events: DataFrame, w, keys, value) -> DataFrame:
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def deduplicated(events: DataFrame, *keys: str, ts: str = "ts") -> DataFrame:
    """Without repeats of the keys; on a stream, of those within the watermark."""
    out = timed(events, ts)
    return out.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else out.dropDuplicates(list(keys))


def joined(a: DataFrame, b: DataFrame, key: str, within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Pairs of events of one key of which b's is at most within later: a stream or table with another."""
    x = timed(a, ts).select(F.col(key), F.col(ts).alias("a_ts"), F.struct("*").alias("a"))
    y = timed(b, ts).select(F.col(key).alias("__k"), F.col(ts).alias("b_ts"), F.struct("*").alias("b"))
    near = (F.col(key) == F.col("__k")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}"))
    return x.join(y, near).drop("__k")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """key and n: how many events of each key so far, emitted at each trigger (state in pandas)."""
    import pandas as pd

    def step(k, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint", "n bigint", "update", "NoTimeout")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now, into an in-memory table (for tests and small results)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is now, appending Parquet files."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_folder(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, and read what it leaves in a new folder as a table: in complete mode the last batch, otherwise all of them. The executors write it, so of any size; a batch that comes again takes its own place."""
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("append").parquet(path)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch-{n}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def run_batches(df: DataFrame, handle, checkpoint: str) -> None:
    """Run a stream over what there is now: handle(batch, batch_id) gets each micro-batch as a table. A batch may come again after a failure, with its id."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
