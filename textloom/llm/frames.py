"""DataFrame plumbing shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named in_0, in_1, ...: no name clashes then, whatever the columns are called."""
    return df.toDF(*[f"in_{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The positional name of the column that is called name exactly, or else without regard to case."""
    names = df.columns
    if name not in names:
        lowered = [c.lower() for c in names]
        if name.lower() not in lowered:
            raise ValueError(f"no column {name!r} among {names}")
        return f"in_{lowered.index(name.lower())}"
    return f"in_{names.index(name)}"


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns of df, under the names given to them."""
    inner = positional(df)
    return inner.select(*[inner[place(df, old)].alias(new) for new, old in columns.items()])


def keep_where(df: DataFrame, condition: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """The rows of df for which the condition holds, with just the columns of df.

    condition gets a function from a column's name to the column."""
    inner = positional(df)
    return inner.where(condition(lambda name: inner[place(df, name)])).toDF(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a temporary one.

    The SparkContext's checkpoint folder is set to it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_textloom_dir", None)
    if at is None:
        at = sc._textloom_dir = "file://" + tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


#: Ids (16 bytes each in a hash table) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def broadcast_checked(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids (narrow rows) with a broadcast hint if they are counted and found to be at most so many."""
    return F.broadcast(ids) if ids.count() <= most else ids


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, where it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored_row(folder: str, column: str, value: int) -> dict:
    """The one row of a partition (column = value) of a table in a folder that all executors share."""
    fs, path = pafs.FileSystem.from_uri(folder)
    return pq.read_table(f"{path}/{column}={value}", filesystem=fs, partitioning=None).to_pylist()[0]


def removed(folder: str) -> None:
    """Delete a folder of this library's own in the shared folder."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.delete_dir(path)


def trim() -> None:
    """Give memory that this worker no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def per_batch(df: DataFrame, make: Callable[[], Callable[[list], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with dicts of columns. make() is called once a task and returns a function
    from the list of a batch's columns (Python lists) to dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for out in step(batch.columns):
                    yield pa.RecordBatch.from_arrays([to_arrow(out[f.name], f.type) for f in arrow], schema=arrow)
                trim()
        finish = getattr(step, "finish", None)
        for out in finish() if finish else ():
            yield pa.RecordBatch.from_arrays([to_arrow(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, kind)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed bytes; of integers, all lowest bytes first, then all second ones and so on."""
    a = np.ascontiguousarray(a)
    if not len(a):
        return b""
    if a.dtype.kind in "iu" and a.itemsize > 1:
        a = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T)
    return pa.compress(a.tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, n: int, kind) -> np.ndarray:
    """The n values that were packed."""
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(b, n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    if kind.kind in "iu" and kind.itemsize > 1:
        flat = np.ascontiguousarray(flat.reshape(kind.itemsize, n).T)
    return flat.view(kind).reshape(n)


#: Tasks whose arrays are added up by one task at first.
FAN = 64


def summed_arrays(df: DataFrame, make: Callable[[], Callable], sizes: int, kind: str = "int64", piece: int = 1 << 13) -> np.ndarray:
    """Arrays of a fixed length from all partitions, added up; the driver gets the one sum.

    make() is called once a task and returns a function that is called with each batch's columns and
    adds to the array that its attribute total holds. Every task sends one array, in pieces; each piece
    is added up for FAN tasks at a time, then for all. Pieces stream through, so a sum's memory is that of one piece."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        some = False
        for batch in batches:
            if batch.num_rows:
                step(batch.columns)
                some = True
                trim()
        task = TaskContext.get()
        fold = (task.partitionId() if task else 0) // FAN
        for k, at in enumerate(range(0, sizes if some else 0, piece)):
            own = step.total[at : at + piece]
            if own.any():
                yield row(k, fold, own)

    def row(k: int, fold: int, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "fold": pa.array([fold], pa.int32()), "packed": pa.array([pack(own)], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for k, fold, b in zip(batch["piece"].to_pylist(), batch["fold"].to_pylist(), batch["packed"], strict=True):
                n = min(piece, sizes - k * piece)
                if out is None:
                    out, at = np.zeros(n, kind), (k, fold)
                out += unpack(b.as_py(), n, kind)
        if out is not None:
            yield row(*at, out)

    added.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "piece int, fold int, packed binary"
    some = df.mapInArrow(part, schema).groupBy("piece", "fold").applyInArrow(added, schema)
    rows = some.groupBy("piece").applyInArrow(added, schema).collect()
    total = np.zeros(sizes, kind)
    for r in rows:
        n = min(piece, sizes - r.piece * piece)
        total[r.piece * piece : r.piece * piece + n] = unpack(bytes(r.packed), n, kind)
    return total
