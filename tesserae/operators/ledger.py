"""Token ledgers and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: code or way of ending: the class of a failure.
FAILURES = {"timeout": "timeout", "crash": "crash", "invalid_json": "protocol", "wrong_protocol": "protocol", "false_capability": "capability", "internal": "candidate", "unsupported": "capability", "infra": "infrastructure"}


def rollup(ledger: DataFrame, key: str, bucket: Column, counted: Column, tokens: str, size: str) -> DataFrame:
    """interactions, bytes, repository_tokens (counted ones) and prompt_tokens of each key."""
    return ledger.groupBy(key).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.sum(size).cast("long").alias("bytes"),
        F.sum(F.when(counted & (bucket == "repository"), F.col(tokens)).otherwise(0)).cast("long").alias("repository_tokens"),
        F.sum(F.when(bucket == "prompt", F.col(tokens)).otherwise(0)).cast("long").alias("prompt_tokens"),
    )


def per_tool(ledger: DataFrame, tool: str, counted: Column, tokens: str) -> DataFrame:
    return ledger.where(counted).groupBy(tool).agg(F.sum(tokens).cast("long").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def replay(events: DataFrame, kind: str, wanted: list[str], key: str, value: Column) -> DataFrame:
    """Usage rebuilt from the event log alone: works on a batch and, in complete mode, on a stream."""
    return events.where(F.col(kind).isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("used"))


def classify_failure(code: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))
    return F.coalesce(F.try_element_at(named, code), F.lit("unknown"))


def run_summary(outcomes: DataFrame, key: str, failed: Column, infra: Column) -> DataFrame:
    """Counts of a run; degraded when over 5 % failed for reasons of the infrastructure."""
    by = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.count_if(infra).alias("infra"))
    return by.withColumn("degraded", F.col("infra") / F.greatest(F.col("n"), F.lit(1)) > 0.05)
