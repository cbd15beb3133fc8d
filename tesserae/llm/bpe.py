"""Byte-level BPE: ids and character offsets from whole texts, and texts from ids.

The vocabulary is a rank file (base64 token, rank).  The engine is the
``tokenizers`` library: each byte is shown to it as one character, and each
match of the split pattern is merged on its own, the lowest rank first, without
special tokens.

Null texts count as empty; an empty text has no ids.  Repeated rows are encoded
each for itself.  Texts are encoded in groups of a bounded number of characters,
so memory does not grow with the batch; one very long text is cut only where the
pattern surely splits, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import in_arrow

#: Characters given to the library at a time.
GROUP_CHARS = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@functools.cache
def tokenizer(path: str, pattern: str):
    """The library's tokenizer over the ranks of a file.

    A pair may merge if its joined bytes have a rank, and goes by that rank:
    so each token contributes every split of it into two tokens.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    show = lambda token: "".join(shown[b] for b in token)
    merges = [
        (show(token[:k]), show(token[k:]))
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    made = Tokenizer(models.BPE({show(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_CHARS characters."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > GROUP_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
        if size >= GROUP_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: No match of the pattern goes on from a visible character into a space, so a text may be cut between them.
_CUT = re.compile(r"\S(?=[ \n])")


def _pieces(text: str) -> list[str]:
    """The text, or a long one's parts."""
    parts, start = [], 0
    while len(text) - start > GROUP_CHARS and (cut := _CUT.search(text, start + GROUP_CHARS)):
        parts.append(text[start : cut.end()])
        start = cut.end()
    return [*parts, text[start:]]


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text, as unsigned 32-bit integers.

    pattern: one whose matches never go on from a visible character into white space.
    """
    engine = tokenizer(path, pattern)
    for a, b in _groups(texts):
        if b - a == 1 and len(texts[a]) > GROUP_CHARS:
            yield np.concatenate([np.array(engine.encode(part, add_special_tokens=False).ids, dtype="<u4") for part in _pieces(texts[a])])
            continue
        for found in engine.encode_batch_fast(texts[a:b], add_special_tokens=False):
            yield np.array(found.ids, dtype="<u4")


@functools.cache
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, with each one's start and length by id."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    lengths = np.array([len(t) for t in by_id], dtype=np.int64)
    return np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes behind the ids: tokens may end inside a character, so bytes are joined before any decoding.

    An id outside the vocabulary raises IndexError.
    """
    data, starts, lengths = _token_table(path)
    if not len(ids):
        return b""
    size = lengths[ids]
    ends = np.cumsum(size)
    return data[np.arange(ends[-1]) + np.repeat(starts[ids] - (ends - size), size)].tobytes()


def token_offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters of the decoded text; a token with a part of a character covers that character."""
    data = np.frombuffer(decode_bytes(ids, path), dtype=np.uint8)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int64)
    ends = np.cumsum(_token_table(path)[2][ids])
    starts = ends - _token_table(path)[2][ids]
    inside = np.zeros(len(ids), dtype=np.int64)
    if len(data):
        inside = ((data[starts] & 0xC0) == 0x80).astype(np.int64)
    return begun[starts] - inside, begun[ends]


def _each_batch(df: DataFrame, schema: str, made) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from made(batch)

    return df.transform(in_arrow, run, schema)


def encode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(id_column, ids array<long>), with starts and ends array<long> in characters if asked for."""
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<long>" + ", starts array<long>, ends array<long>" * offsets

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        done = 0
        for a, b in _groups(texts):
            ids = list(encode_texts(texts[a:b], path, pattern))
            columns = [batch.column(0).slice(done, b - a), pa.array(ids, pa.list_(pa.int64()))]
            if offsets:
                at = [token_offsets(x, path) for x in ids]
                columns += [pa.array([x[k] for x in at], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "starts", "ends"][: len(columns)])
            done += b - a

    return _each_batch(df.select(id_column, text_column), schema, made)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id_column, text string): bytes that are not UTF-8 become U+FFFD."""
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, text string"

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [decode_bytes(np.array(x or [], dtype=np.int64), path).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return _each_batch(df.select(id_column, ids_column), schema, made)


def encode_with_digests(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """(id_column, n_tokens, ids array<int>, ids_sha256, decoded_sha256) of each text: encoded, then decoded from the ids."""
    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        for a, b in _groups(texts):
            found = list(encode_texts(texts[a:b], path, pattern))
            columns = [batch.column(0).slice(at, b - a), pa.array([len(x) for x in found], pa.int64())]
            if ids:
                ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32))))
            columns.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()))
            columns.append(pa.array([hashlib.sha256(decode_bytes(x, path)).hexdigest() for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
            at += b - a

    return _each_batch(df.select(id_column, text_column), f"{id_column} {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string", made)
