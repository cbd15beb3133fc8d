"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

Rows lie in source partitions.  How many rows of each partition go to each
shard is drawn first, from the law that a uniform shuffle of all rows would give
(multivariate hypergeometric, rows and columns of the matrix fixed).  Each
partition then permutes its rows and deals them by its row of the matrix; each
shard permutes what it got.  Shard sizes differ by one at most and every
assignment of rows to slots is equally likely over the seeds.

A source partition is one of the input's own, written once with each row's place in
it: no rows move before they are dealt, and a third of all rows being equal makes no
task larger than another.  Both permutations follow from that place and the seed, so a
task that runs again deals the same way, and the same files read in the same splits
give the same shards.  Nulls are values like any other, repeated rows and very long
texts are rows like any other.  An empty table gives no rows.  The result's columns
shard and slot take the place of the input's, if it has such.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import stored, unused

#: Rows that one task of the second permutation sorts, about.
ROWS_A_TASK = 1_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], dtype=np.int64)


def communication_matrix(sources: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """matrix[p, s]: rows that partition p sends to shard s; rows sum to sources, columns to sizes."""
    random, left, out = np.random.default_rng(seed), sizes.copy(), []
    for n in sources:
        drawn = np.zeros_like(left)
        rest, pool = n, int(left.sum())
        for s, room in enumerate(left):  # one conditional draw after another: the method of marginals
            other = pool - int(room)
            if rest:
                drawn[s] = _hypergeometric(random, int(room), other, rest)
            rest, pool = rest - int(drawn[s]), other
        left = left - drawn
        out.append(drawn)
    return np.array(out, dtype=np.int64).reshape(len(sources), len(sizes))


def _log_factorial(n: int) -> decimal.Decimal:
    """ln n!, exactly for small n, by Stirling's series beyond: good to 30 digits."""
    if n < 2_000:
        return decimal.Decimal(math.factorial(n)).ln()
    x = decimal.Decimal(n)
    half_log = (2 * decimal.Decimal("3.14159265358979323846264338327950288419717")* x).ln() / 2
    return x * x.ln() - x + half_log + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def _hypergeometric(random: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """An exact draw. The library's sampler ends at 10**9; beyond, rejection under a bound by the ratio of uniforms, with decimals of 50 digits."""
    limit = 999_999_999
    if not good or not taken:
        return 0
    if not bad:
        return min(good, taken)
    if good < limit and bad < limit:
        return int(random.hypergeometric(good, bad, taken))
    with decimal.localcontext() as context:
        context.prec = 50
        total, low, high = good + bad, max(0, taken - bad), min(good, taken)
        weight = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(taken - k) + _log_factorial(bad - taken + k))
        mode = min(max((taken + 1) * (good + 1) // (total + 2), low), high)
        top = weight(mode)
        # a log-concave law lies under a table: 1 within a standard deviation of the mode, 1/x**2 beyond
        mean = taken * good / total
        width = 1 + math.sqrt(mean * (bad / total) * (total - taken) / max(1, total - 1)) * 1.8
        while True:
            u, v = 1 - random.random(), random.random() * 2 - 1
            k = mode + round(v / u * width)
            if low <= k <= high and 2 * decimal.Decimal(u).ln() <= weight(k) - top:
                return k


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df with shard int and slot long: slots run from 0 without gaps in each shard."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row, part, first, second, at, range_, begin = (unused(df, x) for x in ("_row", "_part", "_first", "_second", "_at", "_range", "_begin"))
    random = lambda n: F.xxhash64(F.lit(seed), F.lit(n), F.col(row))
    placed = stored(df.select(*kept).withColumn(row, F.monotonically_increasing_id()))
    rows = placed.withColumns({part: F.shiftright(row, 33).cast("int"), first: random(1), second: random(2)})
    counts = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    sources = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[p] for p in sources], shard_sizes(total, shards), seed)
    # permute locally, deal by the matrix
    ends = np.cumsum(matrix, axis=1)
    dealt = spark.createDataFrame([(p, [int(x) for x in ends[k]]) for k, p in enumerate(sources)], f"{part} int, _ends array<bigint>")  # the matrix: partitions by shards
    local = rows.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(first, row)).cast("long")).join(F.broadcast(dealt), part)
    sent = local.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col(at))).cast("int")).select(*kept, row, second, "shard")
    # permute again in each shard: ranges of the second key, so that no task has a shard to itself
    ranges = max(1, -(-total // (shards * ROWS_A_TASK)), int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    sent = stored(sent.withColumn(range_, F.pmod(F.shiftrightunsigned(second, 20), F.lit(ranges)).cast("int")))
    sizes = sent.groupBy("shard", range_).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(sizes.withColumn(begin, F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))  # a row for each million rows: its size is known to the planner
    inside = F.row_number().over(Window.partitionBy("shard", range_).orderBy(second, row)).cast("long") - 1
    return sent.withColumn(at, inside).join(begins, ["shard", range_]).select(*kept, "shard", (F.col(begin) + F.col(at)).alias("slot"))


def document_slots(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """The digest of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
