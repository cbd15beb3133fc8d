r"""Chat formatting: records of many layouts become canonical turns, and turns one text.

A record is a JSON object.  The set of its nested field paths (``messages[].role``)
is hashed; the hash selects a declared mapping, which says where roles and
texts lie.  Records whose hash no mapping declares come back unchanged, with
their hash, in ``unmapped``: none is dropped.

The template writes each turn between control strings.  Inside a role or text,
a control string gets a backslash after its first character (and one more for
each time it already has some), so that none is left whole, and reading takes it
out again: any text comes back as it was.

Null roles and texts count as empty.  Turns go by turn number, nulls first, then
by role and text, so repeated rows and ties have one order.  A conversation
without rows does not appear.  Turns are read in order and folded one at a time:
a very long conversation needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_arrow

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What stands after the first character of each control string: ours, and those of other templates.
_TAILS = r"\|[a-z_]{1,20}\|>|/?s>|</?SYS>>|/?INST\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[]\\*)\\(?={_TAILS})")
def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


class TurnReader:
    """Reads the turns of a formatted conversation that comes in pieces of any size: what is not yet a whole turn is held back.

    Anything but turns end to end is an error.
    """

    def __init__(self) -> None:
        self.held, self.at, self.seen = "", 0, 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn that is now whole; start and end are the code points of its escaped text."""
        self.held += piece
        begun = 0
        while (end := self.held.find(END, max(begun, self.seen))) >= 0:
            middle = self.held.find(TEXT, begun, end)
            if middle < 0 or not self.held.startswith(TURN, begun):
                raise ValueError(f"no turn begins at {self.at + begun}")
            text = middle + len(TEXT)
            yield unescape(self.held[begun + len(TURN) : middle]), unescape(self.held[text:end]), self.at + text, self.at + end
            begun = self.seen = end + len(END)
        self.held, self.at = self.held[begun:], self.at + begun
        self.seen = max(0, len(self.held) - len(END))  # an end mark may be cut in two

    def finish(self) -> None:
        if self.held:
            raise ValueError(f"a turn is not whole at {self.at}")


def _read(formatted: str) -> list[tuple[str, str, int, int]]:
    reader = TurnReader()
    found = list(reader.feed(formatted))
    reader.finish()
    return found


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [x[:2] for x in _read(formatted)]


def loss_spans(formatted: str, roles: frozenset[str] = frozenset({"assistant"})) -> list[tuple[int, int]]:
    """Where the loss counts: code-point ranges of the texts of these roles."""
    return [(start, end) for role, _, start, end in _read(formatted) if role in roles]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    turns: (role, path) in order; a path ``a[].b`` with a role path ``a[].c`` gives a turn for each element.
    required and optional: the field paths that the layout has; any choice of the optional ones has a fingerprint of its own.
    """

    name: str
    required: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        return [fingerprint([*self.required, *x]) for n in range(len(self.optional) + 1) for x in itertools.combinations(self.optional, n)]


_SHARE = {"human": "user", "gpt": "assistant", "system": "system", "tool": "tool"}
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), items=".", role="role", text="text"),
    Mapping("messages", ("conv_id", "messages[].role", "messages[].content"), items="messages", role="role", text="content", optional=("messages[].name", "source")),
    Mapping("shared conversations", ("conv_id", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=_SHARE, optional=("source",)),
    Mapping("instruction", ("conv_id", "instruction", "output"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), ("system", "input")),
    Mapping("prompt", ("conv_id", "prompt", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Mapping("question", ("conv_id", "question", "answer"), (("user", "context"), ("user", "question"), ("assistant", "answer")), ("context",)),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; elements of an array share one path, an empty array or object is a leaf."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths: list[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def map_record(record: dict, mapping: Mapping) -> list[tuple[int, str, str]]:
    """(turn, role, text) of a record."""
    said = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if mapping.items:
        items = [record] if mapping.items == "." else record[mapping.items]
        return [(record["turn"] if mapping.items == "." else k, mapping.roles.get(said(x[mapping.role]), said(x[mapping.role])), said(x[mapping.text])) for k, x in enumerate(items)]
    return [(k, role, said(record[path])) for k, (role, path) in enumerate(mapping.turns) if path in record]


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string()), ("fingerprint", pa.string()), ("unmapped", pa.string())])


def canonical_turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text, layout, fingerprint, unmapped: a row for each turn, and for each record without a mapping or that is no JSON object."""
    by_print = {x: m for m in mappings for x in m.fingerprints()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for said in batch.column(0).to_pylist():
                try:
                    record = json.loads(said or "")
                    at = fingerprint(field_paths(record))
                except ValueError:
                    record, at = None, None
                mapping = by_print.get(at)
                if mapping is None or not isinstance(record, dict):
                    rows.append((None, None, None, None, None, at, said))
                else:
                    rows += [(record["conv_id"], *x, mapping.name, at, None) for x in map_record(record, mapping)]
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows[a : a + 10_000], strict=True), _TURNS, strict=True)], schema=_TURNS)

    return records.select(column).transform(in_arrow, run, "conv_id long, turn long, role string, text string, layout string, fingerprint string, unmapped string")


def _folded(turns: DataFrame, schema: str, start, step, finish) -> DataFrame:
    """One row for each conversation, folded over its turns in order."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, names = None, None, [x.split()[0] for x in schema.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows])
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(finish(now, state))
                    now, state = conv, start()
                step(state, role or "", text or "")
            if done:
                yield pack(done)
        if state is not None:
            yield pack([finish(now, state)])

    return ordered.select("conv_id", "role", "text").transform(in_arrow, run, schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted: the text of each conversation."""
    return _folded(turns, "conv_id long, n_turns long, formatted string", list, lambda s, role, text: s.append(format_turn(role, text)), lambda c, s: (c, len(s), "".join(s)))


#: Code points of a formatted conversation that go to the reader at a time, wherever turns begin and end.
PIECE = 4096


def conversation_digests(turns: DataFrame) -> DataFrame:
    """The digest of each conversation, from what is read back from its whole formatted text.

    The text goes from the template to the reader as it grows, in pieces that know nothing of turns, so that a long conversation is never held as a whole.
    """

    def start() -> dict:
        return {"reader": TurnReader(), "waiting": [], "size": 0, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "loss_chars": 0}

    def read(s: dict, piece: str) -> None:
        for role, text, _, _ in s["reader"].feed(piece):
            s["n"] += 1
            s["turns"].update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                s["loss_chars"] += len(text)
                s["loss"].update(text.encode())

    def step(s: dict, role: str, text: str) -> None:
        formatted = format_turn(role, text)
        s["chars"] += len(formatted)
        s["waiting"].append(formatted)
        s["size"] += len(formatted)
        if s["size"] >= PIECE:
            whole = "".join(s["waiting"])
            end = len(whole) // PIECE * PIECE
            for a in range(0, end, PIECE):
                read(s, whole[a : a + PIECE])
            s["waiting"], s["size"] = [whole[end:]], len(whole) - end

    def finish(conv: int, s: dict) -> tuple:
        read(s, "".join(s["waiting"]))
        s["reader"].finish()
        return conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

    return _folded(turns, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", start, step, finish)


def record_rows(conversations: DataFrame) -> DataFrame:
    """record string: each row of a table of turns as a record; other columns stay out."""
    columns = F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conversations.select(F.to_json(columns, {"ignoreNullFields": "false"}).alias("record"))


def one_record(spark: SparkSession, record: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "record string")
