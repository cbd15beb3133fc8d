"""Benchmark decontamination: size-partitioned MinHash finds short items inside long texts, exact shingles verify.

An item's sketch is its lowest shingle hashes (bottom-k MinHash).  Items lie in
partitions by their number of distinct shingles, up to 2, 4, 8 and so on; in a
partition with at most u shingles the sketch has floor((1 - threshold) * u) + 1
of them.  A text that contains threshold of an item lacks fewer shingles than
that, so it has one of the sketch: no containment over the threshold is missed.
A text that has any is verified by its exact shingles.

Shingles are runs of five words.  Items with fewer words count as one shingle:
only texts that are that very sequence contain them.  Items or texts without
words, nulls among them, match nothing.  Repeated rows match each for itself.

Very long texts are read whole, in parts.  An empty benchmark matches nothing, an
empty table of texts gives no rows.

Distinct item texts get numbers.  Sketch hashes with the items that have them, and the
items' texts, are written as sharded files of the shared folder, which tasks map and
search where the texts lie.  Neither the driver nor a task holds the benchmark, and
texts pass once, however long it is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, new_folder, stored
from ._id_table import open_shard, places, write_table, write_texts
from ._words import each_group, shingle_hashes

WORDS, THRESHOLD = 5, 0.8
#: Bytes of benchmark text in a shard, about.
SHARD_BYTES = 16_000_000
#: Items whose shingles a task keeps for the next text.
KEPT_ITEMS = 2_000


def exact_shingles(text: str, size: int = WORDS) -> frozenset[bytes]:
    words = text.encode().lower().split()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def sketch(text: str, size: int, threshold: float) -> np.ndarray:
    """The lowest shingle hashes of an item, as many as its size partition asks for."""
    shingles = exact_shingles(text, size)
    if not shingles:
        return np.zeros(0, np.uint64)
    joined = pa.array([x.decode() for x in shingles])
    found = np.unique(np.concatenate([shingle_hashes(h, b, size)[0] for *_, h, _s, _e, b in each_group(joined)]))
    most = 1 << (len(shingles) - 1).bit_length()
    return found[: int((1 - threshold) * most + 1e-9) + 1]


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


class Benchmark:
    """The items' files, and which item has which number."""

    def __init__(self, items: DataFrame, item_id: str, text: str, size: int, threshold: float):
        self.size, self.threshold = size, threshold
        top = new_folder(items.sparkSession, "benchmark")
        self.sketches, self.texts = f"{top}/sketches", f"{top}/texts"
        given = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("_item"), F.col(text).alias("_text"))
        numbered = stored(given.select("_text").distinct().withColumn("_number", F.monotonically_increasing_id()))
        #: (_item, _number) of all items with a text
        self.members = given.join(numbered, "_text").select("_item", "_number")
        total = numbered.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
        self.shards = shards = 1 + total // SHARD_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = sketch(said, size, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(hash_shard(found, shards)), pa.array(found.view(np.int64)), pa.array(np.full(len(found), number))], ["_shard", "key", "owner"])

        write_table(numbered.select("_number", "_text").transform(in_arrow, run, "_shard int, key long, owner long"), self.sketches, shards, every=True)
        write_texts(numbered.select(F.col("_number").alias("key"), "_text"), self.texts, shards)


class Matcher:
    """What a task needs to match texts: where the files are."""

    def __init__(self, sketches: str, texts: str, shards: int, size: int, threshold: float):
        self.sketches, self.texts, self.shards, self.size, self.threshold = sketches, texts, shards, size, threshold
        self.shingles = functools.lru_cache(maxsize=KEPT_ITEMS)(self._shingles)

    def _shingles(self, number: int) -> frozenset[bytes]:
        table = open_shard(self.texts, number % self.shards)
        _, (at,) = places(table, np.array([number]))
        a, b = table["ends"][at : at + 2]
        return exact_shingles(table["bytes"][a:b].tobytes().decode(), self.size)

    def candidates(self, hashes: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of texts that have a hash of an item's sketch. of: bounds of the texts among the hashes."""
        out: set[tuple[int, int]] = set()
        shard = hash_shard(hashes, self.shards)
        order = np.argsort(shard, kind="stable") if self.shards > 1 else np.arange(len(hashes))
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard):
            if (table := open_shard(self.sketches, int(s))) is None:
                continue
            mine = order[bounds[s] : bounds[s + 1]]
            which, at = places(table, hashes[mine].view(np.int64))
            text = np.searchsorted(of, mine[which], side="right") - 1
            for t, place in {*zip(text.tolist(), at.tolist(), strict=True)}:
                out.update((t, n) for n in table["owner"][table["starts"][place] : table["starts"][place + 1]].tolist())
        return out

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles shared, shingles of the item) for texts of a batch that contain enough of an item."""
        for a, _b, _data, words, _starts, _ends, bounds in each_group(texts):
            now, shingles = -1, frozenset()
            for t, n in sorted(self.candidates(*shingle_hashes(words, bounds, self.size))):
                if t != now:
                    now, shingles = t, exact_shingles(texts[a + t].as_py(), self.size)
                item = self.shingles(n)
                shared = len(shingles & item)
                if shared >= self.threshold * len(item) - 1e-9:
                    yield a + t, n, shared, len(item)


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment): each text and item of which it contains threshold or more."""
    benchmark = Benchmark(items, item_id, text, size, threshold)
    matcher_of = _opened(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of()
        for batch in batches:
            if rows := list(matcher.matches(batch.column(1))):
                t, *made = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), *(pa.array(x, pa.int64()) for x in made)], ["_doc", "_number", "shared", "shingles"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).transform(in_arrow, run, f"_doc {kind}, _number long, shared long, shingles long")
    # items of one text come apart again
    each = found.join(benchmark.members, "_number")
    return each.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment"))


def _opened(benchmark: Benchmark):
    """What makes a matcher inside a task: it takes names along, no data."""
    named = (benchmark.sketches, benchmark.texts, benchmark.shards, benchmark.size, benchmark.threshold)
    return lambda: Matcher(*named)


def remove(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that contain threshold or more of an item."""
    at, matcher_of = docs.columns.index(text), _opened(Benchmark(items, item_id, text, size, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of()
        for batch in batches:
            leaks = {t for t, *_ in matcher.matches(batch.column(at))}
            yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in leaks], pa.int64())) if leaks else batch

    return docs.transform(in_arrow, run, docs.schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, shingles, containment of documents against the benchmark."""
    return find(docs, items).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), "shared", "shingles", "containment")
