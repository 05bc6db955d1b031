"""Helpers of the training-data operators: columns, stored tables, Arrow batches."""

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.session import checkpoint_root

#: rows of one Arrow batch handed to Python; with whole documents in a row this bounds a worker's memory
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types, so that others cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts lineage with files that every executor can read, so a lost executor
    costs only its running tasks. ``drop_stashes`` removes them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashes(spark).append(path)
    spark._jvm.System.gc()  # shuffle files of the finished write go when its plan is collected
    return spark.read.schema(df.schema).parquet(path)


def keep_until_dropped(spark: SparkSession, path: str) -> None:
    """Count a folder that an operator wrote among its stored tables."""
    _stashes(spark).append(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the stored table that ``df`` reads, once nothing that is still to run needs it."""
    spark = df.sparkSession
    for path in [p for p in _stashes(spark) if any(p.rpartition("/")[2] in f for f in df.inputFiles()[:1])]:
        _delete(spark, path)
        _stashes(spark).remove(path)


def stashed(spark: SparkSession) -> list[str]:
    """The stored tables that are still there."""
    return list(_stashes(spark))


def drop_unread(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Remove those of ``paths`` that ``docs`` does not read."""
    files = docs.inputFiles() if paths else []
    for path in [p for p in paths if not any(p.rpartition("/")[2] in f for f in files)]:
        if path in _stashes(spark):
            _delete(spark, path)
            _stashes(spark).remove(path)
        paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def _stashes(spark: SparkSession) -> list[str]:
    return spark.__dict__.setdefault("_stash_paths", [])


def drop_stashes(spark: SparkSession) -> int:
    """Remove the tables that operators stored, once their results are written."""
    paths = _stashes(spark)
    for p in paths:
        _delete(spark, p)
    n = len(paths)
    paths.clear()
    return n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later stages, and what earlier ones freed would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(lists...) -> dict of lists`` over Arrow batches of all columns of ``df``.

    ``fn`` gets one Python list per column and may return any number of rows.
    """
    names = [x.split()[0] for x in _fields(schema)]

    def run(batches):
        give_back()
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                out = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=_arrow(schema))
        give_back()
    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split(None, 1) for x in _fields(schema))])


def crc_fold(column, parts: int):
    """``crc32(column as text) mod parts``, the fold of a row (null: the text is empty)."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(parts))
