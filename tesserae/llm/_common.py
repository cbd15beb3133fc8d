"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where that is unset, a session in one process takes a temporary folder of its own; on a cluster it is an error, since executors elsewhere would not see such a folder.
    """
    sc = spark.sparkContext
    inner = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (inner.get() if inner.isDefined() else None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not inner.isDefined():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh place below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch. Texts are long: the library's default of 10,000 makes batches of tens of megabytes on both sides.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows in this session, unless it has a smaller number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def release() -> None:
    """Gives freed memory back to the machine: a worker that waits for its next task holds no more than it needs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in small batches, whose workers give their memory back after each task."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(trimmed, schema)


def stored(df: DataFrame, run=None, schema=None) -> DataFrame:
    """The same rows as a table of the shared folder: later jobs neither recompute them nor depend on one executor.

    With run and schema, the table is what in_arrow would make of df: written by the worker that makes it.
    The planner knows the table's size, broadcasts it only if small, and can split its hot keys.  Only tasks that have rows
    write, one file each under a name of its own that a task that runs again replaces: hundreds of empty parts of small
    tables would cost more than their rows.
    """
    spark = df.sparkSession
    folder, made = new_folder(spark, "table"), run or iter
    kind = df.schema if schema is None else spark.createDataFrame([], schema).schema
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        writer, (system, place) = None, file_system(folder)
        name = f"part-{TaskContext.get().partitionId():06}"
        aside = f"{place}/_{name}-{uuid.uuid4().hex}"
        for batch in made(batches):
            if batch.num_rows:
                if writer is None:
                    writer = pq.ParquetWriter(out := system.open_output_stream(aside), batch.schema, compression="snappy", use_dictionary=False, write_statistics=False)
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            replace_file(system, aside, f"{place}/{name}.parquet")
        yield from ()

    in_arrow(df, write, kind).write.format("noop").mode("overwrite").save()
    return spark.read.schema(kind).parquet(folder)


def file_system(path: str):
    """(pyarrow's file system, the path in it)"""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def replace_file(system, aside: str, place: str) -> None:
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        os.replace(aside, place)
    else:
        system.move(aside, place)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made longer until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, helpers: tuple[str, ...]):
    """(df with its columns of these names renamed, the new name of each column, what gives them their names back)."""
    taken = {h.lower() for h in helpers}
    new: dict[str, str] = {}
    for c in df.columns:
        new[c] = c
        while new[c].lower() in taken or (new[c] != c and new[c] in df.columns):
            new[c] += "_"
    moved = {a: b for a, b in new.items() if a != b}
    return df.withColumnsRenamed(moved), new, lambda out: out.withColumnsRenamed({b: a for a, b in moved.items()})


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
