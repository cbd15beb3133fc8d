"""Id tables against a dictionary."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import _id_table
from tesserae.llm._common import new_folder


def test_look_up(spark):
    rows = {k * 7919 % 5003 - 2000: k for k in range(900)} | {2**63 - 1: 5, -(2**63): 6, 0: 7}
    folder = new_folder(spark, "ids")
    df = spark.createDataFrame(list(rows.items()), "key long, value long")
    _id_table.write_table(df, folder, 5)
    asked = spark.createDataFrame([(k,) for k in [*rows, *range(-3000, 3500), 2**62]], "key long")
    table = asked.select(_id_table.shard_of(F.col("key"), 5).alias("s"), "key").toPandas()
    there, value = _id_table.look_up(folder, table["s"].to_numpy(), table["key"].to_numpy(), "value")
    for k, t, v in zip(table["key"], there, value, strict=True):
        assert t == (k in rows) and v == rows.get(k, 0)


def test_equal_keys_and_empty_tables(spark):
    folder = new_folder(spark, "ids")
    _id_table.write_table(spark.createDataFrame([(1, 9), (1, 3)], "key long, value long"), folder, 2)
    shard = spark.range(1).select(_id_table.shard_of(F.lit(1).cast("long"), 2)).first()[0]
    assert _id_table.look_up(folder, np.array([shard]), np.array([1]), "value")[1].tolist() == [3]
    empty = new_folder(spark, "ids")
    _id_table.write_table(spark.createDataFrame([], "key long, value long"), empty, 2)
    assert not _id_table.look_up(empty, np.array([0, 1]), np.array([1, 2]), "value")[0].any()
    assert not _id_table.look_up(empty, np.zeros(0, int), np.zeros(0, np.int64), "value")[0].any()
