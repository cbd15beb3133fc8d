"""Structured Streaming around the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def watch_tree(spark: SparkSession, root: str, checkpoint: str, on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls on_change with each batch of new files (path, modificationTime, length, content): one pass over what is there."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return files.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_stream(events: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Usage by user from the event stream, complete after each batch, in a table in memory."""
    used = ledger.replay(events, "event_type", ["click", "view"], "user_id", F.get_json_object("props", "$.k").cast("long"))
    return used.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events and values by time window and kind; rows later than the watermark no longer count. An addition of this engine's own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def correlate(messages: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """(request_id, status, latency_ms): requests matched with responses by id, whichever comes first; a progress message puts the deadline off; without a response: timeout.

    messages: request_id string, kind string (request, progress, response), at_ms bigint.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            asked, _ = state.get
            state.remove()
            if asked is not None:  # a response that came after its request's deadline waits for no one
                yield pd.DataFrame({"request_id": [key[0]], "status": ["timeout"], "latency_ms": [None]}, dtype=object)
            return
        asked, answered = state.get if state.exists else (None, None)
        for part in parts:
            for kind, at in zip(part["kind"], part["at_ms"], strict=True):
                asked = int(at) if kind == "request" else asked
                answered = int(at) if kind == "response" and answered is None else answered
        if asked is not None and answered is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "status": ["ok"], "latency_ms": [float(answered - asked)]})
        else:
            state.update((asked, answered))
            state.setTimeoutDuration(timeout_ms)

    return messages.groupBy("request_id").applyInPandasWithState(step, "request_id string, status string, latency_ms double", "asked bigint, answered bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def correlate_batch(messages: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """The same over a finished log: late and absent responses are timeouts, and progress puts the deadline off."""
    by = messages.groupBy("request_id").agg(F.min(F.when(F.col("kind") == "request", F.col("at_ms"))).alias("asked"), F.min(F.when(F.col("kind") == "response", F.col("at_ms"))).alias("answered"), F.max(F.when(F.col("kind") == "progress", F.col("at_ms"))).alias("progress"))
    ok = F.col("answered") - F.greatest("asked", F.coalesce(F.when(F.col("progress") < F.col("answered"), F.col("progress")), F.col("asked"))) <= timeout_ms
    return by.where("asked is not null").select("request_id", F.when(ok, "ok").otherwise("timeout").alias("status"), F.when(ok, F.col("answered") - F.col("asked")).cast("double").alias("latency_ms"))
