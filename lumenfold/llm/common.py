"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local["):  # one process, so its own temporary folder is shared
        return f"file://{tempfile.gettempdir()}/lumenfold-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have gone; the folder is only scratch space
            pass


atexit.register(_sweep)


#: Narrow rows of a file, where their number is known beforehand: small tables needn't be a file a partition.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """df, written once as Parquet to the shared folder and read again, so that lost executors cost no recomputation.

    rows: about how many narrow rows it has at most, if that is known; so many files are made as these need. Each file
    and each folder costs its writer a system command where the file system is a local one. codec: of the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").option("compression", codec).parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and what tells how many rows it has (`.get["n"]`) once it was written: without another job."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that written() gave and that nothing will read again."""
    spark, path = df.sparkSession, df._written_at
    _MADE.remove((spark, path))
    _delete(spark, path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is itself a written table (or reads none): the other tables that were written meanwhile go at once."""

    @functools.wraps(f)
    def run(*args, **options) -> DataFrame:
        before = len(_MADE)
        out = f(*args, **options)
        for made in _MADE[before:]:
            if made[1] != getattr(out, "_written_at", None):
                _MADE.remove(made)
                _delete(*made)
        return out

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name: for columns that stand beside those of the input."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Rows of a few numbers each that may be broadcast: about 15 MB.
BROADCAST_ROWS = 100_000


def sized(few: DataFrame) -> DataFrame:
    """few, a written table of narrow rows, as the lesser side of a join: broadcast if its counted rows are below
    BROADCAST_ROWS, so that the other side stays where it is; else hashed by partition, so that the other side
    needn't be sorted. The result is the same."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("shuffle_hash")


def map_rows(df: DataFrame, schema: T.StructType, keep: list[str], row: Callable[[], Callable[..., tuple]], read: list[str]) -> DataFrame:
    """Map each row in Arrow batches: the columns `keep` pass through, and row()(*values of `read`) gives the rest of `schema`.

    row() is called once a task, so that models and caches are built there once.
    """
    rest = [f for f in schema.fields if f.name not in keep]
    types = {f.name: _arrow(f.dataType) for f in rest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = row()
        for b in sliced(batches):
            made = [f(*x) for x in zip(*(b.column(c).to_pylist() for c in read), strict=True)]
            cols = {c: b.column(c) for c in keep} | {x.name: pa.array([r[i] for r in made], types[x.name]) for i, x in enumerate(rest)}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t.fields])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}[t.typeName()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(codes: np.ndarray, n: int, base: int = 0x100000001B3) -> np.ndarray:
    """The 64-bit hash of every run of n code points."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    b, last = np.uint64(base), len(codes) - n + 1
    h = codes[:last].astype(np.uint64)
    for i in range(1, n):
        h = h * b + codes[i : i + last]
    return mixed(h)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df, the first by a hash of key: the same rows however df is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(7), F.col(key)), F.col(key)).limit(most)
