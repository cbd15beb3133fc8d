"""Token budgets: greedy admission with skips, prefix cuts, running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STATE = "struct<used:int,kinds:map<string,int>,admitted:array<string>>"


def admit_greedy(items: Column, budget: int, caps: dict[str, int], default_cap: int) -> Column:
    """struct<used, kinds, admitted> over sorted items (kind, value, cost, with a sort key before them).

    An item over its kind's cap or over the budget is passed by and the next ones still have their chance.
    """
    limit = F.create_map(*(F.lit(x) for pair in {**caps, "": default_cap}.items() for x in pair))

    def step(state: Column, x: Column) -> Column:
        had = F.coalesce(F.try_element_at(state["kinds"], x["kind"]), F.lit(0))
        ok = (had < F.coalesce(F.try_element_at(limit, x["kind"]), F.lit(default_cap))) & (state["used"] + x["cost"] <= budget)
        grown = F.struct(
            (state["used"] + x["cost"]).alias("used"),
            F.map_concat(F.map_filter(state["kinds"], lambda k, _: k != x["kind"]), F.create_map(x["kind"], had + 1)).alias("kinds"),
            F.concat(state["admitted"], F.array(x["value"])).alias("admitted"),
        )
        return F.when(ok, grown).otherwise(state).cast(_STATE)

    start = F.struct(F.lit(0).alias("used"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("kinds"), F.array().cast("array<string>").alias("admitted")).cast(_STATE)
    return F.aggregate(items, start, step)


def admit_prefix(items: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """items with running and admitted: everything from the first overflow on is out."""
    up_to = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(cost).over(up_to)).withColumn("admitted", F.col("running") <= budget)


def within_limit(calls: DataFrame, key: str, order: str, cost: str, limit: int) -> DataFrame:
    """calls with spent_before and allowed: a call goes out while what was spent before it is under the limit."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent_before", F.coalesce(F.sum(cost).over(before), F.lit(0)).cast("long")).withColumn("allowed", F.col("spent_before") < limit)


def drop_report(items: DataFrame, key: str) -> DataFrame:
    """By key and kind: how many items were admitted and dropped, and the dropped cost; admitted + dropped = all."""
    return items.groupBy(key, "kind").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("dropped"), F.sum(F.when(~F.col("admitted"), F.col("cost")).otherwise(0)).alias("dropped_cost"))


def truncated(value: Column, most: int, notice: str = "…[truncated]") -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(notice))).otherwise(value)
