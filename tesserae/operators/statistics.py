"""Dispersion, effect sizes, permutation tests, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z_ALPHA, Z_POWER = 1.95996, 0.84162
EXACT = 18


def _middle(values: Column) -> Column:
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(values, half)).otherwise((F.get(values, half - 1) + F.get(values, half)) / 2)


def _deviation(values: Column) -> Column:
    """The sample's standard deviation; 0 for fewer than two values. By n * sum of d^2 - (sum of d)^2 of the differences d from the median, which is exact for whole values, in any order: running means are not, and a tie or a limit that is met exactly would fall to either side."""
    n, middle, total = F.size(values), _middle(values), lambda f: F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))
    off = total(lambda v: v - middle)
    spread = n * total(lambda v: (v - middle) * (v - middle)) - off * off
    return F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - F.lit(1.0)))))


def dispersion(values: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, median, stdev, iqr (medians of the halves; 0 under four values), cv, min, max and stability of each key.

    For repetitions of a metric: a key's values are few.
    """
    by = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    by = by.withColumn("stdev", _deviation(F.col("_v")))
    half = F.floor(F.col("n") / 2).cast("int")
    iqr = F.when(F.col("n") < 4, 0.0).otherwise(_middle(F.slice("_v", F.col("n").cast("int") - half + 1, half)) - _middle(F.slice("_v", F.lit(1), half)))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("stdev") / F.abs("mean"))
    kind = F.when(cv > 0.20, "unusable").when(cv > 0.05, "noisy").otherwise("stable")
    r = lambda c, name: F.round(c, 6).alias(name)
    return by.select(key, "n", r(F.col("mean"), "mean"), r(_middle(F.col("_v")), "median"), r(F.col("stdev"), "stdev"), r(iqr, "iqr"), r(cv, "cv"), r(F.col("least"), "least"), r(F.col("most"), "most"), kind.alias("stability"))


def detectable_effect(stdev: Column, n: Column | int) -> Column:
    return (Z_ALPHA + Z_POWER) * stdev / F.sqrt(F.lit(n) if isinstance(n, int) else n)


def magnitude(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def cliffs_delta(values: DataFrame, group: str, value: str) -> DataFrame:
    """(left, right, delta, magnitude) of all ordered pairs of groups, left and right swapped with the sign turned.

    By ranks, not by a cross join: how many of the right lie below each value comes from cumulative counts of distinct values.
    """
    counts = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    sizes = values.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.alias("a").join(sizes.alias("b"), F.col(f"a.{group}") < F.col(f"b.{group}")).select(F.col(f"a.{group}").alias("left"), F.col(f"b.{group}").alias("right"), F.col("a.n").alias("n_left"), F.col("b.n").alias("n_right"))
    both = pairs.join(counts.select(F.col(group).alias("left"), F.col(value).alias("v"), F.col("c").alias("cl")), "left").select("left", "right", "n_left", "n_right", "v", "cl", F.lit(0).cast("long").alias("cr")).unionByName(
        pairs.join(counts.select(F.col(group).alias("right"), F.col(value).alias("v"), F.col("c").alias("cr")), "right").select("left", "right", "n_left", "n_right", "v", F.lit(0).cast("long").alias("cl"), "cr")
    )
    each = both.groupBy("left", "right", "n_left", "n_right", "v").agg(F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))
    order = Window.partitionBy("left", "right").orderBy("v")
    below = F.coalesce(F.sum("cr").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("below", below).withColumn("above", F.col("n_right") - F.col("below") - F.col("cr"))
    delta = ranked.groupBy("left", "right").agg((F.sum(F.col("cl") * (F.col("below") - F.col("above"))) / (F.first("n_left") * F.first("n_right"))).alias("delta"))
    turned = delta.select(F.col("right").alias("left"), F.col("left").alias("right"), (-F.col("delta")).alias("delta"))
    out = delta.unionByName(turned).withColumn("delta", F.round("delta", 6) + 0.0)
    return out.withColumn("magnitude", magnitude(F.col("delta")))


def permutation_test(diffs: DataFrame, key: str, array: str, n: int) -> DataFrame:
    """(key, p): sign flips of paired differences, exact for n up to 18 pairs, else every 2**n / 20000th assignment; two-sided.

    Assignments are dealt over tasks; each key's differences are one small array.
    """
    stride = 1 if n <= EXACT else 2**n // 20_000
    signs = diffs.sparkSession.range(0, 2**n, stride).withColumnRenamed("id", "_signs")
    flip = lambda d, i: F.when(F.call_function("shiftright", F.col("_signs"), i).bitwiseAND(F.lit(1).cast("long")) == 0, d).otherwise(-d)
    total = F.aggregate(F.zip_with(array, F.sequence(F.lit(0), F.lit(n - 1)), flip), F.lit(0.0), lambda s, x: s + x)
    observed = F.abs(F.aggregate(array, F.lit(0.0), lambda s, x: s + x))
    rows = signs.crossJoin(F.broadcast(diffs))  # one row for each key of a comparison
    return rows.groupBy(key).agg(F.round(F.count_if(F.abs(total) >= observed - 1e-12) / F.count(F.lit(1)), 6).alias("p_value"))


def triage(values: DataFrame, task: str, candidate: str, value: str) -> DataFrame:
    """flag and discrimination of each task over its candidates: ceiling, floor or informative."""
    by = values.groupBy(task).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(candidate).alias("candidates"))
    flag = F.when(F.col("low") >= 0.95, "ceiling").when(F.col("high") <= 0.05, "floor").otherwise("informative")
    return by.select(task, "candidates", F.round(F.col("high") - F.col("low"), 6).alias("discrimination"), flag.alias("flag"))


def compare_runs(left: DataFrame, right: DataFrame, task: str, value: str) -> DataFrame:
    """shared, mean_left, mean_right, delta and wins over the tasks that both have; comparable says whether there are any."""
    both = left.select(task, F.col(value).alias("l")).join(right.select(task, F.col(value).alias("r")), task)
    return both.agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg("l"), 6).alias("mean_left"), F.round(F.avg("r"), 6).alias("mean_right"), F.round(F.avg(F.col("r") - F.col("l")), 6).alias("delta"), F.count_if(F.col("r") > F.col("l")).alias("wins")).withColumn("comparable", F.col("shared") > 0)
