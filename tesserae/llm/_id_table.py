"""Tables of values by integer key in files of the shared folder, looked up by tasks where their rows are.

A join of a large table with few of its ids would move all its rows.  Here the ids
are dealt to shards by a hash, each shard is one file (an Elias-Fano sequence of
keys with arrays of values), and tasks map the files into memory.  Nothing is
broadcast or held by the driver, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow
from .elias_fano import EliasFano, map_arrays, write_arrays

_SIGN = np.uint64(1 << 63)


def is_integer(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def integer_key(df: DataFrame, column: str) -> Column:
    """Integers as they are; other types by a 64-bit hash."""
    return F.col(column).cast("long") if is_integer(df, column) else F.xxhash64(column)


#: Keys of a shard, about: some ten megabytes.
KEYS_A_SHARD = 1_000_000


def shards_for(table: DataFrame) -> int:
    """As many as the rows of a written table ask for: few tables are opened for each batch while it is small."""
    return 1 + table.count() // KEYS_A_SHARD


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_table(rows: DataFrame, folder: str, shards: int, every: bool = False) -> None:
    """rows: key long without nulls, then values long. Of equal keys the first by values stands, or every one of them.

    A column _shard says where a key goes; without it a hash of the key does.
    """
    values = [c for c in rows.columns if c not in ("key", "_shard")]
    shard = F.col("_shard") if "_shard" in rows.columns else shard_of(F.col("key"), shards)
    ordered = rows.select(shard.cast("int").alias("_shard"), "key", *values).repartition(shards, "_shard").sortWithinPartitions("_shard", "key", *values)

    def made(now: int, held: list[list[np.ndarray]]) -> int:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        first = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
        kept = np.ones(len(first), bool) if every else first
        more = {"starts": np.append(np.flatnonzero(first), len(first))} if every else {}
        write_arrays(f"{folder}/shard-{now}", _keys(columns[0][first]) | more | {name: c[kept] for name, c in zip(values, columns[1:], strict=True)})
        return int(first.sum())

    _each_shard(ordered, made)


def write_texts(rows: DataFrame, folder: str, shards: int) -> None:
    """rows: key long, each once and not negative, then text string: texts by key, in shards by the key's remainder."""
    ordered = rows.select(F.pmod("key", F.lit(shards)).cast("int").alias("_shard"), "key", rows.columns[1]).repartition(shards, "_shard").sortWithinPartitions("_shard", "key")

    def made(now: int, held: list[list]) -> int:
        keys, texts = np.concatenate([x[0] for x in held]), [t.encode() for x in held for t in x[1]]
        write_arrays(f"{folder}/shard-{now}", _keys(keys) | {"ends": np.cumsum([0, *map(len, texts)]), "bytes": np.frombuffer(b"".join(texts), np.uint8)})
        return len(keys)

    _each_shard(ordered, made)


def _keys(sorted_keys: np.ndarray) -> dict[str, np.ndarray]:
    keys = sorted_keys.view(np.uint64) ^ _SIGN
    low, high = int(keys[0]), int(keys[-1])
    return EliasFano.build(keys - np.uint64(low), high - low + 1).arrays("keys") | {"range": np.array([low, high], np.uint64)}


def _each_shard(ordered: DataFrame, made) -> None:
    """made(shard, its columns in parts) in one task for each shard. ordered: _shard and more, all rows of a shard together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        said = lambda: pa.RecordBatch.from_arrays([pa.array([made(now, held)], pa.int64())], ["n"])
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
            for a, b in zip(cuts, [*cuts[1:], len(shard)] if len(cuts) else [], strict=True):
                if shard[a] != now and held:
                    yield said()
                    held = []
                now = int(shard[a])
                parts = [batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)]
                held.append([x.to_pylist() if pa.types.is_string(x.type) else x.to_numpy() for x in parts])
        if held:
            yield said()

    ordered.transform(in_arrow, run, "n long").agg(F.sum("n")).collect()


def open_shard(folder: str, shard: int) -> dict[str, np.ndarray] | None:
    try:
        return map_arrays(f"{folder}/shard-{shard}")
    except FileNotFoundError:  # no key fell there
        return None


def places(table: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys are in the shard, their places among its keys)."""
    asked = keys.view(np.uint64) ^ _SIGN
    low, high = table["range"]
    inside = np.flatnonzero((asked >= low) & (asked <= high))
    at, found = EliasFano.of(table, "keys").successor(asked[inside] - low)
    return inside[found], at[found]


def look_up_all(folder: str, shards: np.ndarray, keys: np.ndarray, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is there, a row of its values or zeros). Keys of an absent shard are not there."""
    there, out = np.zeros(len(keys), bool), np.zeros((len(keys), len(values)), np.int64)
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shards[order][1:] != shards[order][:-1]])) if len(keys) else np.zeros(0, int)
    for a, b in zip(cuts, [*cuts[1:], len(keys)] if len(cuts) else [], strict=True):
        mine = order[a:b]
        if (table := open_shard(folder, int(shards[mine[0]]))) is None:
            continue
        which, at = places(table, keys[mine])
        there[mine[which]] = True
        for k, name in enumerate(values):
            out[mine[which], k] = table[name][at]
    return there, out


def look_up(folder: str, shards: np.ndarray, keys: np.ndarray, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is there, its value or 0)."""
    there, out = look_up_all(folder, shards, keys, [value])
    return there, out[:, 0]
