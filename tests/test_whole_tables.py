"""Queries that cover every row of their tables, against plain Python."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from textloom import plans

DAY = dt.datetime(2024, 1, 1)


def folder(tmp_path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_user_is_resampled(spark, tmp_path):
    rows = [(k, DAY + dt.timedelta(hours=7 * k % 50, minutes=k), user, float(k * k % 13)) for k, user in enumerate([3, 19, 20, 21, 5000, 20, 5000, 3, 20, 5000, 19, 21])]
    at = folder(tmp_path, spark, "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double")
    series = defaultdict(list)
    for _, ts, user, value in rows:
        series[user].append(((ts - dt.datetime(1970, 1, 1)).total_seconds(), value))
    want = []
    for user, own in series.items():
        own.sort()
        g = own[0][0]
        while g <= own[-1][0]:
            t, v = max(x for x in own if x[0] <= g)
            after = [x for x in own if x[0] > g]
            want.append((user, int(g), v + (after[0][1] - v) * (g - t) / (after[0][0] - t) if after else v))
            g += 6 * 3600
    got = sorted((r.user_id, r.secs, r.value) for r in plans.QUERIES["resample_6h"](spark, at).collect())
    assert {u for u, *_ in got} == {3, 19, 20, 21, 5000}
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_every_order_has_a_zip(spark, tmp_path):
    keys = [0, 100_000, 7, 42, 123, 1234, 12345, 212_345]
    at = folder(tmp_path, spark, "orders", list(enumerate(keys)), "o_orderkey bigint, o_custkey bigint")
    got = {r.o_orderkey: r.zip for r in plans.QUERIES["zip_norm"](spark, at).collect()}
    assert got == dict(enumerate(["", "", "", "42", "123", "01234", "12345", "12345"]))


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """20,000 events, whose columns together adaptive execution merges into other partitions than those of the order alone."""
    at = str(tmp_path_factory.mktemp("many"))
    one = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + (F.col("id") * 7919) % 20_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 97).cast("double").alias("value"))
    one.repartition(8).write.parquet(f"{at}/events.parquet")
    settings = {"advisoryPartitionSizeInBytes": "100k", "coalescePartitions.minPartitionSize": "1k", "coalescePartitions.parallelismFirst": "false"}
    before = {f"spark.sql.adaptive.{k}": spark.conf.get(f"spark.sql.adaptive.{k}") for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    yield at, sorted(range(20_000), key=lambda i: (i * 7919) % 20_000)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_circular_lag_of_all(spark, many_events):
    at, ids = many_events
    got = {r.event_id: r.lagged for r in plans.QUERIES["circular_of_all"](spark, at).collect()}
    assert got == {e: float(ids[k - 2] % 97) for k, e in enumerate(ids)}


def test_lags_of_all(spark, many_events):
    at, ids = many_events
    rows = plans.QUERIES["lag_of_all"](spark, at).collect()
    got = {r.event_id: (r.before, r.ahead) for r in rows}
    values = [float(e % 97) for e in ids]
    assert len(rows) == len(ids) and got == {e: (values[k - 1] if k else -1.0, values[k + 3] if k + 3 < len(ids) else None) for k, e in enumerate(ids)}


def test_sliding_windows_of_all(spark, many_events):
    at, ids = many_events
    rows = plans.QUERIES["sliding_of_all"](spark, at).collect()
    assert len(rows) == len(ids) - 3 and {r.event_id: r.ids for r in rows} == {ids[k]: ",".join(map(str, ids[k : k + 4])) for k in range(len(ids) - 3)}
