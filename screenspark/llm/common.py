"""Shared helpers of the training-data operators: tables, scratch tables and Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a per-document kernel holds at a time (a longer text is a step by itself).
SLICE_BYTES = 4 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows handed to Python at a time where a row holds a whole text or set.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset, a local master
    (one machine, as in tests) gets a temporary folder; a cluster gets an error, as a folder of
    one machine would lose the rows that other machines write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it: lineage ends there.

    Shuffle files of the write are removed when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(_CLEAN, None)
    if before is None:  # a Spark without this setting
        df.write.parquet(path)
    else:
        spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes scratch tables that ``materialise`` made and nothing may read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def replace_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """Materialises ``new``, then removes the scratch table ``old``."""
    out = materialise(new)
    discard(old)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Queries that are run inside hand Python at most ``rows`` rows at a time.

    An executor holds a batch several times over (the writer's buffers, the worker's copy), for every core.
    """
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


#: A key with more rows than this is joined by broadcast, so there is at most one such key per ``HOT_ROWS`` rows.
HOT_ROWS = 20_000
#: Narrow tables of at most this many (counted) rows are broadcast as a whole.
FEW_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow table, marked for broadcast if its counted rows are few, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with the table ``keyed``, one narrow row per ``key`` with the number of its rows in ``count``.

    Keys of many rows are joined by broadcast, so no task gets all rows of a key; all others are
    joined by a shuffle (by broadcast too, where ``keyed`` is counted to be small).
    """
    if keyed.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return rows.join(F.broadcast(keyed.drop(count)), key)
    heavy = keyed.filter(F.col(count) > HOT_ROWS).drop(count)
    light = keyed.filter(F.col(count) <= HOT_ROWS).drop(count)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as ``doc_id``, long) and the whole text (as ``text``, null as empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each piece."""
    for batch in batches:
        total = batch.column(column).nbytes
        if total <= limit or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]
