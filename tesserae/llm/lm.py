"""N-gram language model in an Elias-Fano trie, and scores of texts under it.

Training counts words, pairs and triples of the training texts.  Level 1 holds
the hashes of all words, in shards by ranges of the hash, so that a word's rank
is its number; with them their counts.  Pairs and triples lie in shards by a hash
of their first two words.  Each shard is a trie: its own list of first words, and for
each level the pointers from each node to its successors and the successors' words,
all Elias-Fano sequences.  Words are kept relative to their context: to each the last
value of the context before is added, which makes the level one monotone sequence.  A
word is sought among its context's successors alone: the pointers give their range, the
value before the range gives the base, and a successor search of base + word goes over
that range.  Each node keeps the interpolated share of its n-gram, quantised to 16 bits
of the root of its logarithm.

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w | v) = (1 - 0.6) p1(w) + 0.6 c(v w) / c(v), for a v seen in training
    p3(w | u v) = (c(u v w) - 0.75)+ / c(u v) + 0.75 t(u v) / c(u v) p2(w | v), for a pair u v seen in training
    pn = p(n-1) otherwise

t counts the distinct words after u v: all of a pair's successors lie in its shard.  With the
discount, what was seen twice stands apart from what was seen once, also where its context
has no other successor.

A hot word's successors spread over all shards.  Levels are files in the shared
folder, mapped into memory by the scoring tasks: the model is neither broadcast
nor held by the driver, which learns the shards' sizes alone.  Shards are as many
as the session's shuffle partitions, or more where the texts' files ask for it, so that the task that
builds one gets no more at any size.  A word is known by a 64-bit hash.

A text's tokens are its words, A-Z as a-z, then one end; a null or empty text is
an end alone.  Rows without a doc_id are held out as well as scored.  Repeated rows
count each time.  Without training texts every token has p1 = 1 (N = V = 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, new_folder, text_or_empty
from ._words import groups, hashed_words, mix, regrouped, text_buffers
from .elias_fano import EliasFano, map_arrays, write_arrays

_U = np.uint64
ORDER = 3
#: Bytes of the texts' files for each shard at most: what the task that builds it gets is about twice that.
SHARD_BYTES = 256_000_000
#: What a pair's context has in the mixture; what is taken off the count of each triple.
SHARE, DISCOUNT = 0.6, 0.75
#: log10 of a share from 0 down to this, in 16 bits.
FLOOR = -10.0
#: Bytes of text a task takes up at a time, bytes it hashes at a time, and words it gathers before it merges them.
PART, HASHED, GATHER = 6_000_000, 500_000, 2_000_000
_SCHEMA = "shard int, keys binary, lasts binary, counts binary"
_NAMES = ["shard", "keys", "lasts", "counts"]


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def merged(keys: np.ndarray, lasts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and last word, counts of equal ones added."""
    order = np.lexsort((lasts, keys)) if lasts.any() else np.argsort(keys, kind="stable")
    keys, lasts, counts = keys[order], lasts[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (lasts[1:] != lasts[:-1])
    at = np.flatnonzero(first)
    return keys[at], lasts[at], np.add.reduceat(counts, at) if len(at) else counts


def _pieces(keys: np.ndarray, lasts: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys dealt to shards, as differences: where they come sorted these are small."""
    if not len(keys):
        return
    order = np.argsort(shard, kind="stable")
    keys, lasts, counts, shard = keys[order], lasts[order], counts[order], shard[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, b in zip(at, [*at[1:], len(shard)], strict=True):
        row = [int(shard[a])], [_pack(np.diff(keys[a:b], prepend=_U(0)))], [_pack(lasts[a:b].astype("<u4"))], [_pack(counts[a:b].astype("<u4") if counts[a:b].max() < 2**32 else counts[a:b])]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], _NAMES)


class _Gathered:
    """Keys of a task, merged whenever GATHER new ones have come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, lasts: np.ndarray) -> None:
        self.parts.append(merged(keys, lasts, np.ones(len(keys), np.int64)))

    def size(self) -> int:
        return sum(len(x[0]) for x in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts = []
        return out


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so ranks go on from shard to shard."""
    return ((hashes >> _U(40)) * _U(shards) >> _U(24)).astype(np.int64)


def pair_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pairs) % _U(shards)).astype(np.int64)


def _range_start(shard: int, shards: int) -> int:
    return -(-(shard << 24) // shards) << 40


def each_part(batch: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, after the last, word hashes, bounds of texts among words)."""
    data, bounds = text_buffers(batch)
    for a, b in groups(bounds, PART):
        hashes, counts = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
        for c, d in groups(bounds[a : b + 1], HASHED):
            at = bounds[a + c : a + d + 1]
            found, _, _, of = hashed_words(data[at[0] : at[-1]], at - at[0])
            hashes.append(found)
            counts.append(np.diff(of))
        yield a, b, np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class Vocabulary:
    """Level 1: words' numbers and counts, by hash."""

    def __init__(self, folder: str, offsets: list[int], ends: int, tokens: int):
        self.folder, self.offsets, self.ends, self.tokens = folder, offsets, ends, tokens
        self.size = offsets[-1]

    @property
    def end(self) -> int:
        """The number of the token that ends a text."""
        return self.size

    def distinct(self) -> int:
        return self.size + (self.ends > 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count or 0) of sorted distinct hashes."""
        shards = len(self.offsets) - 1
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = word_shard(hashes, shards)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b and self.offsets[s + 1] > self.offsets[s]:
                level = map_arrays(f"{self.folder}/words-{s}")
                at, there = EliasFano.of(level, "words").successor(hashes[a:b] - _U(_range_start(s, shards)))
                number[a:b] = np.where(there, at + self.offsets[s], -1)
                count[a:b] = np.where(there, level["counts"][np.minimum(at, len(level["counts"]) - 1)], 0)
        return number, count

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct() + 1))

    def token_numbers(self, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, count of each token with the ends; the text of each; bounds of the texts among tokens)."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = self.find(distinct)
        texts = len(of) - 1
        bounds = of + np.arange(texts + 1)
        numbers, counts = np.full(bounds[-1], self.end, np.int64), np.full(bounds[-1], self.ends, np.int64)
        owner = np.repeat(np.arange(texts), np.diff(of))
        at = np.arange(len(hashes)) + owner
        numbers[at], counts[at] = number[back], count[back]
        return numbers, counts, np.repeat(np.arange(texts), np.diff(bounds)), bounds


def train_vocabulary(texts: DataFrame, folder: str, shards: int) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, ends = _Gathered(), 0
        for batch in regrouped(batches, PART):
            ends += batch.num_rows
            for *_, hashes, _of in each_part(batch.column(0)):
                got.add(hashes, np.zeros(len(hashes), np.int64))
                if got.size() > GATHER:
                    keys, lasts, counts = got.take()
                    if len(keys) > GATHER // 2:
                        yield from _pieces(keys, lasts, counts, word_shard(keys, shards))
                    else:
                        got.parts = [(keys, lasts, counts)]
        if got.parts:
            keys, lasts, counts = got.take()
            yield from _pieces(keys, lasts, counts, word_shard(keys, shards))
        # a text's end is a token too: counted under shard -1
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([_pack(np.array([x]))], pa.binary()) for x in (0, 0, ends))], _NAMES)

    def build(shard: int, keys: np.ndarray, _lasts: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        if shard < 0:
            return 0, int(counts.sum())
        start = _range_start(shard, shards)
        write_arrays(f"{folder}/words-{shard}", {**EliasFano.build(keys - _U(start), _range_start(shard + 1, shards) - start).arrays("words"), "counts": counts})
        return len(keys), int(counts.sum())

    sizes = _reduced(texts.transform(in_arrow, count, _SCHEMA), build, shards)
    rows = {r["shard"]: (r["n"], r["total"]) for r in sizes.collect()}  # a row for each shard
    ends = rows.pop(-1, (0, 0))[1]
    offsets = np.concatenate([[0], np.cumsum([rows.get(s, (0, 0))[0] for s in range(shards)])]).tolist()
    return Vocabulary(folder, offsets, ends, sum(x[1] for x in rows.values()) + ends)


def _reduced(pieces: DataFrame, build, shards: int) -> DataFrame:
    """(shard, n, total): build(shard, keys, lasts, counts) over all pieces of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            n, total = build(now, *merged(*(np.concatenate(x) for x in zip(*held, strict=True))))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "n", "total"])

        for batch in batches:
            for shard, keys, lasts, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if shard != now:
                    if held:
                        yield done()
                    now, held = shard, []
                if shard < 0:
                    held.append((_unpack(keys, "<i8").astype(_U), _unpack(lasts, "<i8"), _unpack(counts, "<i8")))
                    continue
                k = np.cumsum(_unpack(keys, "<u8"), dtype=_U)
                c = _unpack(counts, "<u1")
                held.append((k, _unpack(lasts, "<u4").astype(np.int64), (c.view("<u4") if len(c) == 4 * len(k) else c.view("<i8")).astype(np.int64)))
        if held:
            yield done()

    return pieces.repartition(shards, "shard").sortWithinPartitions("shard").transform(in_arrow, run, "shard int, n long, total long")


def _ngrams(numbers: np.ndarray, text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of pairs, pairs as one number, places of triples, their last words): known words only, inside a text."""
    ok = numbers >= 0
    pair = np.flatnonzero(ok[:-1] & ok[1:] & (text[:-1] == text[1:])) if len(numbers) > 1 else np.zeros(0, int)
    pairs = (numbers[pair].astype(_U) << _U(32)) | numbers[np.minimum(pair + 1, max(len(numbers) - 1, 0))].astype(_U)
    follow = np.zeros(len(numbers), bool)
    follow[pair] = True
    triple = pair[follow[np.minimum(pair + 1, max(len(numbers) - 1, 0))]]
    return pair, pairs, triple, numbers[np.minimum(triple + 2, max(len(numbers) - 1, 0))]


def quantise(share: np.ndarray) -> np.ndarray:
    """16 bits of the root of the logarithm: likely words, which long texts repeat most, are kept finest."""
    return np.round(np.sqrt(np.clip(np.log10(share) / FLOOR, 0, 1)) * 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (FLOOR * (code / 65535.0) ** 2)


def build_trie(pairs: np.ndarray, triples: np.ndarray, lasts: np.ndarray, counts: np.ndarray, pair_counts: np.ndarray, first_counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The arrays of a shard. pairs: sorted distinct, with counts of the pairs and of their first words; triples: the pair of each, sorted."""
    first, second = (pairs >> _U(32)).astype(np.int64), (pairs & _U(2**32 - 1)).astype(np.int64)
    roots, begin = np.unique(first, return_index=True)
    out = EliasFano.build(roots.astype(_U), size).arrays("roots")
    out |= _level("2", np.append(begin, len(pairs)), second)
    out["shares2"] = quantise(SHARE * pair_counts / first_counts)
    node = np.searchsorted(pairs, triples)
    bounds = np.searchsorted(node, np.arange(len(pairs) + 1))
    out |= _level("3", bounds, lasts)
    out["shares3"] = quantise((counts - DISCOUNT) / pair_counts[node]) if len(node) else np.zeros(0, np.uint16)
    # what the discounts of a context's words leave to the shorter context; a pair that only ends texts has no words after it
    kinds = np.diff(bounds)
    out["backs3"] = quantise(np.where(kinds > 0, DISCOUNT * kinds / pair_counts, 1.0))
    return out


def _level(name: str, bounds: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """Pointers to each context's words, and the words, each raised by the last value of the context before. bounds: where contexts begin, and the end."""
    some = np.flatnonzero(np.diff(bounds))
    last = np.zeros(len(bounds) - 1, np.int64)
    last[some] = words[bounds[some + 1] - 1]
    base = np.cumsum(last) - last
    values = (words + np.repeat(base, np.diff(bounds))).astype(_U)
    return EliasFano.build(bounds.astype(_U), len(words) + 1).arrays(f"pointers{name}") | EliasFano.build(values, int(values[-1]) + 1 if len(values) else 1).arrays(f"words{name}")


def successors(level: dict[str, np.ndarray], name: str, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the level, whether it is there) of each word among its context's successors. contexts: sorted."""
    distinct, of = np.unique(contexts, return_inverse=True)
    pointers, level_words = EliasFano.of(level, f"pointers{name}"), EliasFano.of(level, f"words{name}")
    begin, end = (x.astype(np.int64) for x in pointers.access_pairs(distinct))
    base = np.zeros(len(distinct), _U)
    base[begin > 0] = level_words.access(begin[begin > 0] - 1)
    any_ = (begin < end)[of]
    at, there = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
    of = of[any_]
    at[any_], there[any_] = level_words.successor_in(base[of] + words[any_].astype(_U), begin[of], end[of])
    return at, there


def train_trie(texts: DataFrame, vocabulary: Vocabulary, shards: int) -> None:
    """Writes the shards of pairs and triples."""
    none = 2**32 - 1  # the last word of a pair's own row

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, PART):
            for *_, hashes, of in each_part(batch.column(0)):
                numbers, _, text, _ = vocabulary.token_numbers(hashes, of)
                place, pairs, triple, last = _ngrams(numbers, text, vocabulary.end)
                distinct, back, times = np.unique(pairs, return_inverse=True, return_counts=True)
                # a triple as the rank of its pair here and its last word: one number, sorted in place
                codes, often = np.unique((back[np.searchsorted(place, triple)].astype(_U) << _U(32)) | last.astype(_U), return_counts=True)
                keys, lasts = np.concatenate([distinct, distinct[codes >> _U(32)]]), np.concatenate([np.full(len(distinct), none, np.int64), (codes & _U(2**32 - 1)).astype(np.int64)])
                yield from _pieces(keys, lasts, np.concatenate([times, often]), pair_shard(keys, shards))

    def build(shard: int, keys: np.ndarray, lasts: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        own = lasts == none
        pairs = keys[own]
        first, back = np.unique(pairs >> _U(32), return_inverse=True)
        write_arrays(f"{vocabulary.folder}/trie-{shard}", build_trie(pairs, keys[~own], lasts[~own], counts[~own], counts[own], vocabulary_counts(vocabulary, first.astype(np.int64))[back], vocabulary.size + 1))
        return len(pairs), int((~own).sum())

    _reduced(texts.transform(in_arrow, count, _SCHEMA), build, shards).agg(F.sum("n"), F.sum("total")).collect()


def vocabulary_counts(vocabulary: Vocabulary, numbers: np.ndarray) -> np.ndarray:
    """Counts of words by their sorted numbers."""
    out = np.zeros(len(numbers), np.int64)
    cuts = np.searchsorted(numbers, vocabulary.offsets)
    for s in range(len(vocabulary.offsets) - 1):
        a, b = cuts[s], cuts[s + 1]
        if a < b:
            out[a:b] = map_arrays(f"{vocabulary.folder}/words-{s}")["counts"][numbers[a:b] - vocabulary.offsets[s]]
    return out


def _known_shards(folder: str, shard: int) -> dict[str, np.ndarray] | None:
    try:
        return map_arrays(f"{folder}/trie-{shard}")
    except FileNotFoundError:  # no pair fell there
        return None


def token_probabilities(vocabulary: Vocabulary, shards: int, numbers: np.ndarray, counts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The probability of each token after those before it in its text."""
    p = vocabulary.p1(counts)
    # a word that was never followed is no context; every training word is followed by a word or an end
    seen = np.zeros(len(numbers), bool)
    seen[1:] = (text[1:] == text[:-1]) & (numbers[:-1] >= 0)
    p2 = np.where(seen, (1 - SHARE) * p, p)
    place, pairs, triple, last = _ngrams(numbers, text, vocabulary.end)
    if not len(place):
        return p2
    distinct, back = np.unique(pairs, return_inverse=True)
    shard = pair_shard(distinct, shards)
    share2, share3, rest3 = np.zeros(len(distinct)), np.zeros(len(triple)), np.ones(len(distinct))
    node = np.full(len(distinct), -1, np.int64)
    of_triple = back[np.searchsorted(place, triple)]
    shard = shard.astype(np.uint16) if shards < 2**16 else shard  # few values sort by their digits
    order, size = np.argsort(shard, kind="stable"), _U(vocabulary.size + 1)
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    third = np.argsort(shard[of_triple], kind="stable")
    cuts3 = np.searchsorted(shard[of_triple][third], np.arange(shards + 1))
    for s in np.unique(shard):
        level = _known_shards(vocabulary.folder, int(s))
        if level is None:
            continue
        mine = order[cuts[s] : cuts[s + 1]]  # sorted, since the distinct pairs are and the order is stable
        pair = distinct[mine]
        first, of_first = np.unique(pair >> _U(32), return_inverse=True)
        root, there = EliasFano.of(level, "roots").successor(first)
        root, there = root[of_first], there[of_first]
        mine, pair, root = mine[there], pair[there], root[there]
        at, there = successors(level, "2", root, pair & _U(2**32 - 1))
        mine, at = mine[there], at[there]
        share2[mine], rest3[mine], node[mine] = restore(level["shares2"][at]), restore(level["backs3"][at]), at
        ask = third[cuts3[s] : cuts3[s + 1]]
        ask = ask[node[of_triple[ask]] >= 0]
        if len(ask):
            want = node[of_triple[ask]].astype(_U) * size + last[ask].astype(_U)
            values, again = np.unique(want, return_inverse=True)
            at, there = successors(level, "3", (values // size).astype(np.int64), values % size)
            share = np.zeros(len(values))
            share[there] = restore(level["shares3"][at[there]])
            share3[ask] = share[again]
    p2[place + 1] += share2[back]
    p3 = p2.copy()
    known = np.flatnonzero(node[back] >= 0)
    known = known[place[known] + 2 < len(numbers)]
    known = known[text[place[known]] == text[place[known] + 2]]
    p3[place[known] + 2] *= rest3[back[known]]
    np.add.at(p3, triple + 2, share3)
    return p3


def train(texts: DataFrame, column: str = "text") -> Vocabulary:
    """The model of these texts, in files of the shared folder."""
    spark = texts.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SHARD_BYTES)
    only = texts.select(text_or_empty(column).alias("text"))
    vocabulary = train_vocabulary(only, new_folder(spark, "language-model"), shards)
    if vocabulary.size >= 2**32 - 2:
        raise ValueError("more words than 32 bits can number")
    train_trie(only, vocabulary, shards)
    return vocabulary


def scores(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score, score of each row of docs (with a text)."""
    shards = len(vocabulary.offsets) - 1
    rows = docs.select(*keep, text_or_empty().alias("text"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, PART):
            for a, b, hashes, of in each_part(batch.column(len(keep))):
                numbers, counts, text, bounds = vocabulary.token_numbers(hashes, of)
                add = lambda x, at=bounds: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has a token at least
                p = token_probabilities(vocabulary, shards, numbers, counts, text)
                made = np.diff(bounds), add((counts > 0).astype(np.int64)), np.full(b - a, vocabulary.tokens), add(np.log10(vocabulary.p1(counts))), add(np.log10(p))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *map(pa.array, made)], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.transform(in_arrow, run, schema)


def document_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of documents; the rest of crc32(doc_id) by 5 being 1 holds out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 1, F.lit(True)).alias("held_out"), "text")
    return scores(rows, train(rows.where("not held_out")), ["doc_id", "held_out"])
