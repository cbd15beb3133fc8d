"""Retrieval metrics over ranked results and gold items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = (1, 5, 10)


def covered(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(probe, item, rank): where each gold item is first covered. results: probe, rank, item; gold: probe, item."""
    return results.join(gold, ["probe", "item"]).groupBy("probe", "item").agg(F.min("rank").alias("rank"))


def metrics(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """A row for each probe of the gold: recall and precision at 1, 5, 10, reciprocal rank, nDCG at k.

    A probe without results has zeros. nDCG gains once for each result that covers a new item.
    """
    first = covered(results, gold)
    size = gold.groupBy("probe").agg(F.count_distinct("item").alias("n"))
    by = first.groupBy("probe").agg(
        *(F.count_if(F.col("rank") <= a).alias(f"hit{a}") for a in AT),
        *(F.count_distinct(F.when(F.col("rank") <= a, F.col("rank"))).alias(f"right{a}") for a in AT),
        F.min("rank").alias("best"),
        F.collect_set(F.when(F.col("rank") <= k, F.col("rank"))).alias("ranks"),
    )
    gain = F.aggregate(F.array_sort("ranks"), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(by, "probe", "left").select(
        "probe",
        *(F.round(zero(F.col(f"hit{a}") / F.col("n")), 6).alias(f"recall_at_{a}") for a in AT),
        *(F.round(zero(F.col(f"right{a}") / a), 6).alias(f"precision_at_{a}") for a in AT),
        F.round(zero(1 / F.col("best")), 6).alias("mrr"),
        F.round(zero(gain / ideal), 6).alias("ndcg"),
    )


def mean_and_worst(values: DataFrame, task: str, key: str, value: str, probes: str) -> DataFrame:
    """(task, key, mean, worst, brittle) over a task's probes; a key that a probe lacks counts 0."""
    grid = values.select(task, probes).distinct().join(values.select(task, key).distinct(), task)
    full = grid.join(values, [task, probes, key], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    out = full.groupBy(task, key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("worst"))
    return out.withColumn("brittle", F.col("mean") - F.col("worst") > 0.30)


def weighted_correctness(parts: dict[str, tuple[Column, float]]) -> Column:
    """The mean of the parts that apply (not null), by their weights renormalized; 0 if none applies."""
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(total / weight)


def context_efficiency(base: Column, used: Column) -> Column:
    return F.when(base <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base - used) / base)))
