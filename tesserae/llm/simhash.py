"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is 1 where over half of the text's shingle hashes have it.
Fingerprints that differ in few bits link; linked texts form components.

Comparison: rows that share a block key lie next to each other in a partition.
Their fingerprints are stored as bit planes, one bit vector for each bit.  Row i
and row i + d are compared for all i at once: planes are xored with themselves
shifted by d, and carry-save counters, started so that they overflow past the
radius, add the 64 pairs of a machine word with each operation.  Words of pairs
that have all overflowed are abandoned.

Block keys make sure that linked rows meet.  Exact: of n blocks of bits, a pair
that differs in r bits at most agrees on some n - r of them; each choice of n - r
blocks is a key, and n grows with the table, so that key groups stay small.  The
pipeline's stage takes bands of minimum hashes of the shingles instead, which find
similar texts at any radius.

Hot groups.  Texts of one fingerprint are one node.  A key group with more rows
than a cell holds is compared in two steps, so that its cost is near linear:
first each chunk of it with itself and with the group's pivots, a sample by hash;
then, once the components so far are known, only the rows outside the group's
largest component with everything.  Pairs inside that component need no
comparison, being connected already; no other pair is left out.

Null texts and texts without words have fingerprint zero, linked like any other.
A null id stays null and takes no part in a component's smallest id.  Rows that
are repeated come back repeated.  An empty table gives an empty one.  Very long
texts are hashed whole, a bounded number of bits at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, new_folder, stored, unused
from ._id_table import integer_key, is_integer, look_up, look_up_all, shard_of, shards_for, write_table
from ._words import each_group, mix, shingle_hashes
from .components import roots

#: Rows of a chunk of a large key group. Blocks of exact keys are so many that groups of evenly spread bits hold GROUP rows at most.
CELL, GROUP = 1024, 4096
#: Rows that a task compares at a time: whole cells.
BUFFER = 65_536


def xxh64_bits(text: str, size: int) -> np.ndarray:
    """The fingerprint of a text by XXH64 (seed 42) of its shingles, 8 bytes, the highest bit first."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(8, np.uint8)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :] or ends[-1:])]  # noqa: B905
    total, done = np.zeros(64, np.int64), len(hashes)
    for k in range(0, done, 65_536):
        part = np.array(hashes[k : k + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > done)


def wide_bits(texts: pa.Array, size: int, bits: int) -> Iterator[np.ndarray]:
    """Fingerprints of bits (a multiple of 64) for groups of a batch: arrays of rows by bits / 8."""
    for a, b, _data, words, _s, _e, bounds in each_group(texts):
        hashes, of = shingle_hashes(words, bounds, size)
        counts = np.diff(of)
        out = np.zeros((b - a, bits // 8), np.uint8)
        some = np.flatnonzero(counts)
        if len(some):
            for k in range(bits // 64):
                sums = np.zeros((len(some), 64), np.int64)
                mixed = mix(hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))).view(np.uint8).reshape(-1, 8)
                # the bits of so many shingles at a time
                at = 0
                while at < len(some):
                    end = max(at + 1, int(np.searchsorted(of[some], of[some[at]] + 150_000)))
                    part = slice(of[some[at]], of[some[min(end, len(some)) - 1] + 1])
                    sums[at:end] = np.add.reduceat(np.unpackbits(mixed[part], axis=1), of[some[at:end]] - of[some[at]], axis=0, dtype=np.int32)
                    at = end
                out[some, 8 * k : 8 * k + 8] = np.packbits(2 * sums > counts[some, None], axis=1)
        yield out


def fingerprints(docs: DataFrame, size: int, bits: int = 64, contract_hash: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp binary): contract_hash takes XXH64 of the shingles' bytes, else hashes of their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if contract_hash:
                made = [xxh64_bits(x or "", size).tobytes() for x in batch.column(1).to_pylist()]
            else:
                made = [row.tobytes() for group in wide_bits(batch.column(1), size, bits) for row in group]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_column, "fp"])

    return docs.select(id_column, text).transform(in_arrow, run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, fp binary")


def exact_keys(rows: int, radius: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Keys as lists of (first bit, number of bits): a pair within the radius shares one of them.

    The number of blocks is the least whose key groups hold GROUP rows at most when bits are even.
    """
    for blocks in range(radius + 1, radius + 6):
        cuts = [round(bits * k / blocks) for k in range(blocks + 1)]
        parts = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(blocks)]
        if rows <= GROUP * 2 ** (bits * (blocks - radius) / blocks):
            break
    return [list(x) for x in itertools.combinations(parts, blocks - radius)]


def masks(keys: list[list[tuple[int, int]]], bits: int) -> list[list[int]]:
    """For each key the mask of each 64-bit word (signed): fingerprints with equal masked words agree on the key's bits."""
    out = []
    for parts in keys:
        chosen = {b for first, n in parts for b in range(first, first + n)}
        words = [sum(1 << (63 - b % 64) for b in chosen if b // 64 == w) for w in range(bits // 64)]
        out.append([w - 2**64 if w >= 2**63 else w for w in words])
    return out


def first_of(*columns: np.ndarray) -> np.ndarray:
    """For each row the first row that has the same values."""
    order = np.lexsort((np.arange(len(columns[0])), *columns))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def forest(planes_of: np.ndarray, cell: np.ndarray, radius: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row of its linked set within its cell.

    planes_of: rows by bytes, sorted by cell.  Rows link within the radius; rows of a cell with one value of known are linked already.
    """
    n = len(planes_of)
    label = np.arange(n) if known is None else first_of(cell, known)
    if n < 2:
        return label
    words = (n + 63) // 64
    packed = np.packbits(np.ascontiguousarray(np.unpackbits(planes_of, axis=1).T), axis=1, bitorder="little")
    planes = np.zeros((packed.shape[0], 16 * words + 16), np.uint8)
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])
    ends = np.append(np.flatnonzero(first)[1:], n)
    left = ends[np.cumsum(first) - 1] - np.arange(n)  # rows from here to the cell's end
    width = max(1, (radius + 1).bit_length())
    begin = (1 << width) - 1 - radius  # so that one difference too many overflows
    row = np.arange(n)
    for d in range(1, int(left.max())):
        row = row[left[row] > d]
        pairs = row[label[row] != label[row + d]]
        if not len(pairs):
            if not len(row):
                break
            continue
        marked = np.zeros(64 * words, bool)
        marked[pairs] = True
        mask = np.packbits(marked, bitorder="little").view(np.uint64)
        at = np.flatnonzero(mask)
        alive = mask[at]
        skip, shift = divmod(d, 64)
        counters = [np.full(len(at), (2**64 - 1) if begin >> k & 1 else 0, np.uint64) for k in range(width)]
        for p in range(0, len(planes), 8):
            part = planes[p : p + 8]
            other = part[:, at + skip] if skip else part[:, at]
            if shift:
                other = (other >> np.uint64(shift)) | (part[:, at + skip + 1] << np.uint64(64 - shift))
            alive = alive & ~_add_eight(counters, part[:, at] ^ other)
            keep = alive != 0
            if not keep.all():  # abandon the words whose pairs are all too far apart
                at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
                if not len(at):
                    break
        if len(at):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(hit)
            _union(label, at[which] * 64 + bit, d)
    return label


def _add_eight(counters: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Adds eight bit vectors to the counters: carry-save adders make one four-bit number of them, which ripples in. What overflows comes back."""
    a, b, c = x[0:2], x[2:4], x[4:6]
    u = a ^ b
    one, two = u ^ c, (a & b) | (u & c)
    u = one[0] ^ one[1]
    s, carry = u ^ x[6], (one[0] & one[1]) | (u & x[6])
    ones, more = s ^ x[7], s & x[7]
    u = two[0] ^ two[1]
    t, four = u ^ carry, (two[0] & two[1]) | (u & carry)
    twos, again = t ^ more, t & more
    number = (ones, twos, four ^ again, four & again)
    over = np.zeros_like(ones)
    rest = np.zeros_like(ones)
    for k, old in enumerate(counters):
        if k < 4:
            u = old ^ number[k]
            counters[k], rest = u ^ rest, (old & number[k]) | (u & rest)
        else:
            counters[k], rest = old ^ rest, old & rest
    over |= rest
    for k in range(len(counters), 4):
        over |= number[k]
    return over


def _union(label: np.ndarray, rows: np.ndarray, d: int) -> None:
    """Joins each row with the row d further on; every label stays the first row of its set."""
    a, b = label[rows], label[rows + d]
    while (differ := a != b).any():
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        parent = np.arange(len(label))
        np.minimum.at(parent, high, low)
        while not np.array_equal(nxt := parent[parent], parent):
            parent = nxt
        label[:] = parent[label]
        a, b = label[rows], label[rows + d]


def _kept_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to whole cells (column 0, by which rows are sorted), of at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cell = whole.column(0).to_numpy(zero_copy_only=False)
            end = int(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[-1])
            if end:
                yield whole.slice(0, end)
            held = [whole.slice(end)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """The first so many bytes of each value, rows by bytes; values of one length."""
    joined = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.ascontiguousarray(joined.reshape(len(column), -1)[:, :width])


def _linked(batch: pa.RecordBatch, label: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) from each row to the first of its set; column 1 has the nodes."""
    rows = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), batch.column(1).take(pa.array(label[rows]))], ["a", "b"])


def _edges(cells: DataFrame, radius: int, bits: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each cell. cells: _cell, node, fp, _known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _kept_groups(batches, BUFFER):
            cell, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            yield _linked(batch, forest(_bytes_of(batch.column(2), bits // 8), cell, radius, known))

    kind = cells.schema["node"].dataType.simpleString()
    return _in_cells(cells.select("_cell", "node", "fp", "_known")).transform(in_arrow, run, f"a {kind}, b {kind}")


def _in_cells(cells: DataFrame) -> DataFrame:
    return cells.repartition(_shards(cells), "_cell").sortWithinPartitions("_cell", "node")


def _sizes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, _n) of the keys with more rows than most."""
    return stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))


def _first_cells(rows: DataFrame, sizes: DataFrame, key: str, most: int) -> DataFrame:
    """rows with _cell: rows of one key together; those of a large key in chunks, each with the pivots. _known: all differ.

    Pivots are as many as fit an eighth of a chunk, on average.
    """
    h = F.xxhash64("node")
    pivot = F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.floor(F.col("_n") / max(2, min(64, most // 8))), F.lit(1).cast("long"))) == 0
    chunks = F.ceil(F.col("_n") / most)
    at = F.when(F.col("_n").isNull(), F.array(F.lit(-1).cast("long"))).when(pivot, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(F.pmod(h, chunks)))
    return rows.join(sizes, key, "left").withColumn("_at", F.explode(at)).withColumns({"_cell": F.xxhash64(key, "_at"), "_known": h}).drop("_at", "_n")


def _rest_plan(named: DataFrame, key: str) -> DataFrame | None:
    """(key, _main, _n, _rest): the largest component of each large key and the rows outside it, None if there are none. named: key, node, _comp."""
    by = named.groupBy(key, "_comp").agg(F.count(F.lit(1)).alias("_c"))
    plan = stored(by.groupBy(key).agg(F.max_by("_comp", F.struct("_c", "_comp")).alias("_main"), F.sum("_c").alias("_n"), (F.sum("_c") - F.max("_c")).alias("_rest")).where("_rest > 0"))
    return None if plan.isEmpty() else plan


def _rest_cells(named: DataFrame, plan: DataFrame, key: str, most: int) -> DataFrame:
    """named with _cell so that each row outside its key's largest component meets all rows of the key. named: key, node, _comp and more."""
    rows = named.join(plan, key)
    h, outside = F.xxhash64("node"), F.col("_comp") != F.col("_main")
    zero = F.lit(0).cast("long")
    c, r = F.ceil(F.col("_n") / most), F.ceil(F.col("_rest") / most)
    i, j = F.pmod(h, c), F.pmod(F.shiftrightunsigned(h, 20), r)
    inside_cells = F.transform(F.sequence(zero, r - 1), lambda k: i * r + k)
    rest_cells = F.concat(F.transform(F.sequence(zero, c - 1), lambda k: k * r + j), F.transform(F.sequence(zero, r - 1), lambda k: c * r + F.least(j, k) * r + F.greatest(j, k)))
    at = F.when(outside, rest_cells).otherwise(inside_cells)
    return rows.withColumn("_at", F.explode(at)).withColumns({"_cell": F.xxhash64(key, F.lit(1), "_at"), "_known": F.xxhash64("_comp")}).drop("_at", "_main", "_n", "_rest")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with _comp: the root of the node, itself where it has none."""
    return rows.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("_comp", F.coalesce("root", "node")).drop("_node", "root")


def linked(keyed: DataFrame, radius: int, bits: int) -> DataFrame:
    """(node, root) of nodes that links within the radius connect, but for the roots. keyed: _key, node, fp: the rows that share a key are compared."""
    sizes = _sizes(keyed, "_key", CELL)
    found = roots(_edges(_first_cells(keyed, sizes, "_key", CELL), radius, bits))
    if sizes.isEmpty():
        return found
    named = stored(_with_component(keyed.join(sizes.drop("_n"), "_key", "left_semi"), found))
    plan = _rest_plan(named, "_key")
    if plan is None:
        return found
    more = _edges(_rest_cells(named, plan, "_key", CELL), radius, bits)
    return roots(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def with_keys(nodes: DataFrame, bits: int, keys: list[list[tuple[int, int]]]) -> DataFrame:
    """(_key, node, fp): each node under each of its keys of bits."""
    words = {f"_w{k}": F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long") for k in range(bits // 64)}
    of_keys = F.array(*(F.array(F.lit(k).cast("long"), *(F.lit(w).cast("long") for w in m)) for k, m in enumerate(masks(keys, bits))))
    rows = nodes.withColumns(words).withColumn("_m", F.explode(of_keys))
    return rows.select(F.xxhash64(F.col("_m")[0], *(F.col(f"_w{w}").bitwiseAND(F.col("_m")[w + 1]) for w in range(bits // 64))).alias("_key"), "node", "fp")


def node_rows(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints with a salt, the salted texts, nodes) of prints (_id, fp), or of a written table of them that has its salts.

    A text's copies, which may be many, are counted and named by (fp, _salt), so that they spread over tasks.  A node is
    the least id of a fingerprint and a tag of it, should the id have other texts; ids that are null come last.
    """
    if "_salt" not in prints.columns:
        own = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
        prints = stored(prints.withColumn("_salt", F.pmod(F.xxhash64("_id", own), F.lit(_shards(prints))).cast("int")))
    salted = stored(prints.groupBy("fp", "_salt").agg(F.min("_id").alias("_id")))
    least = salted.groupBy("fp").agg(F.min("_id").alias("_id"))
    return prints, salted, stored(least.select(F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.xxhash64("fp").alias("tag")).alias("node"), "fp"))


def named_prints(prints: DataFrame, salted: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(_id, fp, component_id) of all prints."""
    named = _with_component(nodes, found).select("fp", F.col("_comp.id").alias("component_id"))
    each = salted.select("fp", "_salt").join(named, "fp")
    return prints.join(each, ["fp", "_salt"]).select("_id", "fp", "component_id")


def components(prints: DataFrame, radius: int, bits: int = 64, keys=exact_keys, id_column: str = "doc_id") -> DataFrame:
    """prints (id, fp) with component_id: the smallest id of the texts reachable by links, its own included."""
    prints, salted, nodes = node_rows(prints.select(F.col(id_column).alias("_id"), "fp"))
    found = linked(with_keys(nodes, bits, keys(nodes.count(), radius, bits)), radius, bits)
    return named_prints(prints, salted, nodes, found).select(F.col("_id").alias(id_column), "fp", "component_id")


def document_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: 4-word shingles, XXH64, links at 4 or fewer bits."""
    found = components(fingerprints(docs, 4, contract_hash=True), 4)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


#: Near copies in the pipeline: five words, a similarity of 0.8.  Bands of minimum hashes name candidates, fingerprints of 256 bits
#: within the radius pass them on, and exact Jaccard similarity decides.  At a similarity of 0.8 a pair shares one of nine bands of
#: three with a chance of 1 - (1 - 0.8**3)**9 = 0.998, and differs in 39 bits on average with a standard deviation of 6: the radius is four of them off.
NEAR_WORDS, NEAR_BITS, NEAR_RADIUS, NEAR_SIMILARITY = 5, 256, 64, 0.8
BANDS, BAND_ROWS = 9, 3
#: Rows of a chunk of a large group of candidates: sets of shingles are compared there.
VERIFY_CELL = 128


def minimum_hashes(hashes: np.ndarray, of: np.ndarray, seed: int = 7) -> np.ndarray:
    """For each text BANDS keys of BAND_ROWS minimum hashes each, as bytes; zeros for texts without shingles. of: bounds of the texts among the hashes."""
    random = np.random.default_rng(seed)
    odd = random.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(of) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(of))
    if len(some):
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for by in odd[band]:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * by, of[some]))
            out[some, band] = key
    return out.view(np.uint8).reshape(len(out), -1)


def sketches(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_id, fp binary, _salt), written: a fingerprint of NEAR_BITS, then the bands' keys; the salts of a task's rows go round."""
    salts = _shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId()
        for batch in batches:
            made = []
            for (_a, _b, _data, words, _s, _e, bounds), fps in zip(each_group(batch.column(1)), wide_bits(batch.column(1), NEAR_WORDS, NEAR_BITS), strict=True):
                bands = minimum_hashes(*shingle_hashes(words, bounds, NEAR_WORDS))
                made += [row.tobytes() for row in np.concatenate([fps, bands], axis=1)]
            salt = ((seen + np.arange(batch.num_rows)) % salts).astype(np.int32)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(salt)], ["_id", "fp", "_salt"])

    return stored(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")), run, f"_id {docs.schema[id_column].dataType.simpleString()}, fp binary, _salt int")


def _set_bytes(hashes: np.ndarray, of: np.ndarray) -> list[bytes]:
    """The sorted distinct shingle hashes of each text, 32 bits each."""
    return [np.unique((hashes[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]


def shingle_sets(docs: DataFrame, members: DataFrame, id_column: str, text: str) -> DataFrame:
    """(node, _group, fp, shingles) of the texts of members (node, _group long). Texts that don't belong there stay where they lie."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    ids = members.where("not node.unnamed")
    folder, shards, key = new_folder(spark, "candidates"), shards_for(ids), integer_key(docs, id_column)
    write_table(ids.withColumn("_id", F.col("node.id")).select(integer_key(ids.select(F.col("node.id").alias("_id")), "_id").alias("key"), F.col("node.tag").alias("tag"), "_group"), folder, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            there, found = look_up_all(folder, shard, keys, ["tag", "_group"])
            tag, group = found.T
            texts = batch.column(3).filter(pa.array(there))
            if not len(texts):
                continue
            fps, sets = [], []
            for (_a, _b, _data, words, _s, _e, bounds), prints in zip(each_group(texts), wide_bits(texts, NEAR_WORDS, NEAR_BITS), strict=True):
                hashes, of = shingle_hashes(words, bounds, NEAR_WORDS)
                fps += [row.tobytes() for row in np.concatenate([prints, minimum_hashes(hashes, of)], axis=1)]
                sets += _set_bytes(hashes, of)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(there)), pa.array(tag[there]), pa.array(group[there]), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["_id", "tag", "_group", "fp", "shingles"])

    found = docs.where(F.col(id_column).isNotNull()).select(shard_of(key, shards).alias("_shard"), key.alias("_key"), F.col(id_column).alias("_id"), F.col(text).alias("_text")).transform(in_arrow, run, f"_id {kind}, tag long, _group long, fp binary, shingles binary")
    # an id's other texts have another tag
    return found.where(F.xxhash64("fp") == F.col("tag")).select(F.struct(F.lit(False).alias("unnamed"), F.col("_id").alias("id"), "tag").alias("node"), "_group", "fp", "shingles")


def verified_forest(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row of its set: rows within the radius link if their sets' Jaccard similarity reaches the threshold."""
    label = np.arange(len(fps)) if known is None else first_of(known)
    bits, sizes = fps.view(np.uint64), np.array([len(x) for x in sets])
    for i in range(len(fps) - 1):
        near = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i])]
        near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= radius]
        for j in near:
            if label[i] == label[j]:
                continue
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def _verified(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links that exact similarity confirms. cells: _cell, node, fp, _known, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _kept_groups(batches, 1):
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
                part = batch.slice(a, b - a)
                sets = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column(4)]
                known = part.column(3).to_numpy(zero_copy_only=False)
                yield _linked(part, verified_forest(_bytes_of(part.column(2), NEAR_BITS // 8), sets, radius, NEAR_SIMILARITY, known))

    kind = cells.schema["node"].dataType.simpleString()
    return _in_cells(cells.select("_cell", "node", "fp", "_known", "shingles")).transform(in_arrow, run, f"a {kind}, b {kind}")


def _confirmed(members: DataFrame, sets_of, radius: int) -> DataFrame:
    """(node, root) by exact similarity among the members (node, _group) of each group; sets_of(members) gives their sets."""
    members = stored(members)
    sizes = _sizes(members, "_group", VERIFY_CELL)
    found = roots(_verified(_first_cells(sets_of(members), sizes, "_group", VERIFY_CELL), radius))
    if sizes.isEmpty():
        return found
    named = stored(_with_component(members.join(sizes.drop("_n"), "_group", "left_semi"), found))
    plan = _rest_plan(named, "_group")
    if plan is None:
        return found
    open_ = stored(named.join(plan.select("_group"), "_group", "left_semi"))
    again = sets_of(open_.select("node", "_group")).join(open_.select("node", "_group", "_comp"), ["node", "_group"])
    more = _verified(_rest_cells(again, plan, "_group", VERIFY_CELL), radius)
    return roots(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) of documents with an id: near copies by exact similarity, found among fingerprints within the radius."""
    prints, salted, nodes = node_rows(sketches(docs, id_column, text))
    at = NEAR_BITS // 8
    bands = F.array(*(F.substring("fp", at + 8 * k + 1, 8) for k in range(BANDS)))
    keyed = nodes.select("node", "fp", F.posexplode(bands).alias("_k", "_band")).select(F.xxhash64("_k", "_band").alias("_key"), "node", F.substring("fp", 1, at).alias("fp"))
    loose = linked(keyed, NEAR_RADIUS, NEAR_BITS)
    members = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct()).select("node", F.xxhash64("root").alias("_group"))
    found = _confirmed(members, lambda some: shingle_sets(docs, some, id_column, text), NEAR_RADIUS)
    return named_prints(prints, salted, nodes, found).select(F.col("_id").alias(id_column), "component_id")


def exact_near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """As near_groups, but no pair can be missed: each text's lowest (1 - similarity) n + 1 of n shingle hashes are its keys.

    Two sets of that similarity share one of these.  Keys grow with the texts' lengths, and a passage in many texts makes hot keys: for corpora of moderate size, or to measure the recall of near_groups.
    """
    prints, salted, nodes = node_rows(sketches(docs, id_column, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for data in batch.column(1).to_pylist():
                x = np.frombuffer(data, "<u4").astype(np.int64)
                keys.append(x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    members = stored(nodes.where("not node.unnamed").select("node", F.lit(0).cast("long").alias("_group")))
    sets = stored(shingle_sets(docs, members, id_column, text).drop("_group").dropDuplicates(["node"]))
    keyed = sets.select("node", "shingles").transform(in_arrow, run, f"node {sets.schema['node'].dataType.simpleString()}, keys array<long>").select("node", F.explode("keys").alias("_group"))
    found = _confirmed(keyed, lambda some: some.join(sets, "node"), NEAR_BITS)
    return named_prints(prints, salted, nodes, found).select(F.col("_id").alias(id_column), "component_id")


def _shards(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, the first of equal ids by a hash of their values.

    Rows with a null id form no group and stay.  Ids with other rows of another text link by any of their texts.
    """
    given = docs.where(F.col(id_column).isNotNull())
    found = stored(near_groups(given, id_column))
    # what does not simply stay: 1 goes, 2 is an id of several rows
    of_id = found.groupBy(id_column).agg(F.max(F.when(F.col("component_id") == F.col(id_column), 1).otherwise(0)).alias("_own"), F.count(F.lit(1)).alias("_n"))
    marks = stored(of_id.where("_own = 0 or _n > 1").select(F.col(id_column).alias("_id"), F.when(F.col("_own") == 0, 1).otherwise(2).cast("long").alias("mark")))
    mark = unused(docs, "_mark")
    marked = _marked(docs, marks, id_column, mark)
    once = marked.where(F.col(mark) == 0).drop(mark)
    if not marks.where("mark = 2").isEmpty():
        again = marked.where(F.col(mark) == 2).drop(mark)
        order = F.struct(F.xxhash64("text"), F.xxhash64(*[c for c in docs.columns if c != id_column]))
        once = once.unionByName(again.groupBy(id_column).agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*"))
    return once


def _marked(docs: DataFrame, marks: DataFrame, id_column: str, mark: str) -> DataFrame:
    """docs with mark: that of the row's id in marks (_id, mark), 0 for other ids and null ones.

    Integer ids are looked up where the rows lie, in files that tasks map; other ids are joined, since only the ids themselves tell them apart for certain.
    """
    if not is_integer(docs, id_column):
        side = stored(marks).select(F.col("_id").alias(key := unused(docs, "_id")), F.col("mark").alias("_m" + mark))
        return docs.join(side, F.col(id_column) == F.col(key), "left").select(*docs.columns, F.coalesce("_m" + mark, F.lit(0).cast("long")).alias(mark))
    folder, shards = new_folder(docs.sparkSession, "dropped-ids"), shards_for(marks)
    write_table(marks.select(integer_key(marks, "_id").alias("key"), "mark"), folder, shards)
    key = F.when(F.col(id_column).isNotNull(), integer_key(docs, id_column))
    n, names = len(docs.columns), [*docs.columns, mark]
    schema = docs.withColumn(mark, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            given = np.flatnonzero(batch.column(n + 1).is_valid().to_numpy(zero_copy_only=False))
            shard, keys = (batch.column(k).take(pa.array(given)).to_numpy() for k in (n, n + 1))
            found[given] = look_up(folder, shard, keys, "mark")[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(found)], names)

    return docs.select("*", shard_of(key, shards).alias(unused(docs, "_shard")), key.alias(unused(docs, "_key"))).transform(in_arrow, run, schema)
