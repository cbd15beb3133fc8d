"""The driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are heavy: texts to split and scan.
HEAVY = ("documents", "pages", "conversations")
#: Tables of a fixed size.
SMALL = ("nation", "region")
#: Rows of a task that parses or renders a file for each row.
TASK_ROWS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """The table. Texts, or rows that much work will be done on, are dealt out first if they lie in fewer splits than there are cores: a large table has splits enough and moves nowhere.

    heavy: rows are small beside the work that each of them makes, so that the number of tasks follows from the rows: a split of repeated values holds millions of them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if heavy:
        parts = 1 if name in SMALL else max(cores, -(-df.count() // TASK_ROWS))
        return df.repartition(parts) if splits < parts else df
    if name in HEAVY and splits * 2 <= cores:
        return df.repartition(cores)
    return df


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that all executors share; a session in one process without such a folder takes a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="index-")
    return f"{shared.rstrip('/')}/index-{uuid.uuid4().hex}"
