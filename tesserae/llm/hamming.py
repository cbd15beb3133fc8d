"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, as wide as the table has codes for; each segment has
a hash table from its value to the codes that have it.  In round r each open query
looks up all values at r bits from its own in each segment: by the pigeonhole
principle, after that every code closer than segments * (r + 1) has been met and
verified.  A query is done when its kth verified distance lies under that bound;
the others go on to the next radius, up to a segment's whole width, where all codes
have been met.  The values of a round come from those of the round before, each
with one more bit flipped, so they are made by the tasks and not by the driver.

Equal codes share one entry, with their k smallest ids: no other of them can be
among the k nearest.  Neighbours go by distance, then by id; a query is no
neighbour of its own row, but equal codes of other rows are.  Null vectors have no
code and are neither queries nor neighbours; null elements count as not positive.
Rows with a null id are left out.  A repeated id stands for one row,
that with the smallest code.  A table with fewer than k other rows gives what there is,
an empty one nothing.  Vectors longer than the bits asked for count by their first bits.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import stored

def sign_code(vector: str, words: int) -> Column:
    """array<long>: a bit for each element, 1 if positive, 64 to a word; elements past the last word are left out by the caller's choice of words."""
    bit = lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.aggregate(F.slice(vector, 64 * k + 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(bit(x)))
    return F.array(*(word(k) for k in range(words)))


def distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))


def segments_of(bits: int, codes: int) -> list[tuple[int, int]]:
    """(first bit, width): segments of about log2(codes) bits, inside words of 64."""
    width = min(32, max(4, round(math.log2(max(codes, 2)))))
    out = []
    for word in range(0, bits, 64):
        size = min(64, bits - word)
        n = max(1, round(size / width))
        cuts = [word + size * k // n for k in range(n + 1)]
        out += [(a, b - a) for a, b in itertools.pairwise(cuts)]
    return out


def _segment(code: str, first: int, width: int, bits: int) -> Column:
    word, at = divmod(first, 64)
    size = min(64, bits - 64 * word)
    return F.shiftrightunsigned(F.col(code)[word], size - at - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _by_segment(df: DataFrame, code: str, parts: list[tuple[int, int]], bits: int) -> DataFrame:
    return df.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("seg"), _segment(code, *p, bits).alias("val")) for n, p in enumerate(parts)))).alias("_s")).select("*", "_s.seg", "_s.val").drop("_s")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark keeps k rows of each before it shuffles."""
    at = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))
    return found.withColumn("rank", at).where(F.col("rank") <= k)


def _expanded(pairs: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """(query, neighbor, distance) from (query, code number, distance): codes become their ids."""
    near = _best(pairs.withColumnRenamed("code_id", "neighbor"), k + 1).drop("rank").withColumnRenamed("neighbor", "code_id")
    return near.join(codes.select("code_id", "ids"), "code_id").select("query", "distance", F.explode("ids").alias("neighbor")).where("neighbor <> query")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, bits: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, neighbor, distance): the k nearest codes to each query's, exactly.

    queries: rows of the same columns.
    """
    spark, words = vectors.sparkSession, (bits + 63) // 64
    coded = lambda df: df.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), sign_code(vector, words).alias("code"))
    rows = stored(coded(vectors).groupBy("id").agg(F.min("code").alias("code")))
    # k + 1 ids of a code: one of them may be the query's own
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = rows.withColumn("_n", first).where(F.col("_n") <= k + 1)
    codes = stored(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("code_id", F.element_at("ids", 1)))
    open_ = stored(coded(queries).groupBy("id").agg(F.min("code").alias("code")).select(F.col("id").alias("query"), F.col("code").alias("q")))
    total = codes.count()
    parts = segments_of(bits, total)
    widths = F.array(*(F.lit(w) for _, w in parts))
    index = stored(_by_segment(codes.select("code_id", "code"), "code", parts, bits))
    found = spark.createDataFrame([], "query long, code_id long, distance int")
    asked = _by_segment(open_, "q", parts, bits).withColumn("top", F.lit(-1))  # the highest bit flipped so far
    done: list[DataFrame] = []
    for radius in range(max(w for _, w in parts) + 1):
        if radius:
            more = F.when(F.col("top") + 1 < F.get(widths, F.col("seg")), F.sequence(F.col("top") + 1, F.get(widths, F.col("seg")) - 1)).otherwise(F.array().cast("array<int>"))
            flipped = asked.select("query", "q", "seg", "val", F.explode(more).alias("top"))
            asked = flipped.withColumn("val", F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("top"))))
        asked = stored(asked)
        met = asked.join(index, ["seg", "val"]).select("query", "code_id", distance("q", "code").cast("int").alias("distance"))
        # a code met in two segments or rounds counts once; per distance only the nearest k + 1 codes matter
        found = stored(_best(found.unionByName(met).distinct().withColumnRenamed("code_id", "neighbor"), k + 1).select("query", F.col("neighbor").alias("code_id"), "distance"))
        if radius == max(w for _, w in parts):
            done.append(_expanded(found, codes, k))  # all codes have been met
            break
        covered = len(parts) * (radius + 1) - 1
        sizes = codes.select("code_id", F.size("ids").alias("n"))
        ready = stored(found.where(F.col("distance") <= covered).join(sizes, "code_id").groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= k + 1).select("query"))
        done.append(_expanded(found.join(ready, "query", "left_semi"), codes, k))
        asked, found = asked.join(ready, "query", "left_anti"), found.join(ready, "query", "left_anti")
        open_ = stored(open_.join(ready, "query", "left_anti"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _best(out.distinct(), k).select("query", F.col("rank").cast("int").alias("rank"), "neighbor", F.col("distance").cast("int").alias("distance"))


def embedding_neighbors(embeddings: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """query, rank, neighbor, distance: the rows whose id is divisible by 50 against all rows, by the signs of 64 dimensions."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % every == 0), k, 64)
