"""Symbols, facts, references, imports and keyword candidates of one file, by language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name
from . import config_files, generic, markdown, python_source, record
from .record import Extraction

SYMBOL = (
    "stable_key:string,parent_key:string,kind:string,name:string,qualified_name:string,visibility:string,signature:string,return_type:string,doc:string,is_async:boolean,is_exported:boolean,"
    "line_start:int,line_end:int,interface_hash:string,behavior_hash:string,doc_hash:string,metadata_hash:string,decorators:array<string>"
)
FACT = "symbol_key:string,kind:string,value:string,priority:int,confidence:double,line:int"
REF = "source_key:string,kind:string,name:string,line:int,receiver:string,arity:int"
IMPORT = "module:string,alias:string,names:array<struct<orig:string,local:string>>,level:int,line:int"
KEYWORD = "symbol_key:string,term:string,source:string"
SCHEMA = f"path string, parse_state string, structure_hash string, error string, symbols array<struct<{SYMBOL}>>, facts array<struct<{FACT}>>, refs array<struct<{REF}>>, imports array<struct<{IMPORT}>>, keywords array<struct<{KEYWORD}>>, rejected array<struct<kind:string,value:string>>"

#: language: extractor (path, text, file class) -> Extraction. Others may be registered.
ADAPTERS: dict[str, Callable[[str, str, str], Extraction]] = {
    "python": python_source.extract, "markdown": markdown.extract, **dict.fromkeys(("toml", "json", "ini", "yaml", "env"), config_files.extract),
}


def extract_file(path: str, language: str, file_class: str, state: str, text: str) -> Extraction:
    """Binary, oversized and generated files give their metadata alone; an extractor's error fails the file, not the task."""
    if state in ("binary", "oversized", "failed") or file_class in ("binary", "generated"):
        return record.metadata_only(path, language, "metadata" if state == "pending" else state)
    try:
        return ADAPTERS.get(language, lambda p, t, c: generic.extract(p, t, c, language))(path, text, file_class)
    except Exception as error:  # noqa: BLE001
        out = record.metadata_only(path, language, "failed")
        out.error = f"{type(error).__name__}: {error}"[:200]
        return out


#: Files of a slice: what a task parses before it hands rows on.  Its memory follows from this and not from the size of its partition.
SLICE = 200
#: Rows and bytes of an Arrow batch of file texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 1024 * 1024
LISTS = {"symbols": SYMBOL, "facts": FACT, "refs": REF, "imports": IMPORT, "keywords": KEYWORD, "rejected": "kind:string,value:string"}
_HASHES = frozenset(("interface_hash", "behavior_hash", "doc_hash", "metadata_hash"))


def _fields(members: str) -> dict[str, str]:
    """Names and types of a struct's members, nested ones whole."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(members):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(members[at:k])
            at = k + 1
    return dict(x.split(":", 1) for x in (*out, members[at:]))


def _wanted(lists: dict[str, list[str] | None]) -> frozenset[str]:
    """What the extractors need to find for these lists and fields."""
    symbols = lists.get("symbols", [])
    return frozenset(lists) | ({"hashes"} if symbols is None or _HASHES.intersection(symbols) else set())


def _arrow(spark_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spark_schema))


def _release() -> None:
    """Gives freed memory back: a worker that waits for its next task holds no more than it needs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def _small_batches(spark) -> None:
    """Arrow batches of few rows and bytes in this session, unless it has smaller ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        had = spark.conf.get(name).lower().removesuffix("b")
        if not had.isdigit() or not 0 < int(had) <= most:
            spark.conf.set(name, str(most))


def _in_slices(files: DataFrame, schema: str, columns, found: frozenset[str] | None) -> DataFrame:
    """files through the extractors, a slice at a time. columns: what a slice's extractions are in the schema's columns."""
    kind = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            with record.only(found):
                for batch in batches:
                    for at in range(0, batch.num_rows, SLICE):
                        given = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                        made = columns([extract_file(*row) for row in zip(*given, strict=True)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, kind, strict=True)], schema=kind)
        finally:
            _release()

    _small_batches(files.sparkSession)
    return files.select("path", "language", "file_class", "parse_state", "content_text").mapInArrow(run, schema)


def extract(files: DataFrame, lists: dict[str, list[str] | None] | None = None) -> DataFrame:
    """A row for each described file, with its lists. lists: those that are asked for, with their fields (None: all); the others are not looked for."""
    if lists is None:
        return _in_slices(files, SCHEMA, lambda made: list(zip(*(x.row() for x in made), strict=True)), None)
    kept = {name: [f for f in _fields(LISTS[name]) if fields is None or f in fields] for name, fields in lists.items()}
    schema = ", ".join(["path string", *(f"{name} array<struct<{','.join(f'{f}:{_fields(LISTS[name])[f]}' for f in fields)}>>" for name, fields in kept.items())])

    def columns(made: list[Extraction]) -> list[list]:
        for x in made:
            x.row()  # puts the lists in order
        return [[x.path for x in made], *([[{f: row[f] for f in fields} for row in getattr(x, name)] for x in made] for name, fields in kept.items())]

    return _in_slices(files, schema, columns, _wanted(lists))


def extract_rows(files: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(path, *fields): one list of all files, a row for each of its members, without the others."""
    schema = ", ".join(["path string", *(f"{f} {_fields(LISTS[name])[f]}" for f in fields)])

    def columns(made: list[Extraction]) -> list[list]:
        for x in made:
            x.row()
        each = [(x.path, row) for x in made for row in getattr(x, name)]
        return [[path for path, _ in each], *([row[f] for _, row in each] for f in fields)]

    return _in_slices(files, schema, columns, _wanted({name: fields}))


def exploded(extracted: DataFrame, column: str) -> DataFrame:
    return extracted.select("path", F.explode(column).alias("_x")).select("path", "_x.*")


def _rows_of_files(files: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]]) -> DataFrame:
    """The rows (path, text) -> rows of each Python file, a slice of files at a time."""
    kind = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    made = [row for path, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True) for row in rows(path, text)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kind, strict=True)], schema=kind)
        finally:
            _release()

    _small_batches(files.sparkSession)
    return files.where("language = 'python'").select("path", "content_text").mapInArrow(run, schema)


def _tags(path: str, text: str) -> list[tuple]:
    lines = text.splitlines()
    return [(path, *tag, lines[tag[3] - 1].strip()[:300]) for tag in generic.tags(text)]


def tag_rows(files: DataFrame) -> DataFrame:
    """(path, name, kind, scope, line, signature): the index of tags of Python files, a row for each; a name's scope is the dotted path of what it stands in."""
    return _rows_of_files(files, "path string, name string, kind string, scope string, line int, signature string", _tags)


def member_rows(files: DataFrame) -> DataFrame:
    """members(tag_rows(files)): a member and its owner stand in one file, so that no row moves."""

    def rows(path: str, text: str) -> list[tuple]:
        tags, owners = generic.tags(text), {}
        for name, kind, scope, _ in tags:
            if kind in ("c", "f", "m"):
                owners.setdefault(f"{scope}.{name}" if scope else name, []).append(name)
        return [(path, owner, name, kind, line) for name, kind, scope, line in tags for owner in owners.get(scope, ())]

    return _rows_of_files(files, "path string, owner string, name string, kind string, line int", rows)


def occurrence_rows(files: DataFrame) -> DataFrame:
    """(path, module, name, line): every name in Python files that parse, with the file's module name."""

    def rows(path: str, text: str) -> list[tuple]:
        try:
            return [(path, name, line) for name, line in python_source.occurrences(text)]
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # a broken file has no tree
            return []

    found = _rows_of_files(files, "path string, name string, line int", rows)
    return found.select("path", module_name(F.col("path")).alias("module"), "name", "line")


def members(tags: DataFrame) -> DataFrame:
    """(path, owner, name, kind, line): tags joined to the class or function in whose scope they stand."""
    owners = tags.where("kind in ('c', 'f', 'm')").select("path", F.concat_ws(".", F.nullif("scope", F.lit("")), "name").alias("scope"), F.col("name").alias("owner"))
    return tags.join(owners, ["path", "scope"]).select("path", "owner", "name", "kind", "line")
