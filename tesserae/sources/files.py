"""Source trees as tables: discovery, reading with a cap, head sniffing, numbered lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..functions.text import language_of

MAX_BYTES, HEAD = 2 * 1024 * 1024, 4096
MAX_DEPTH = 32
EXCLUDE = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/dist/**", "**/build/**"]
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".md": "markdown", ".rst": "text", ".txt": "text", ".toml": "toml", ".json": "json", ".ini": "ini", ".cfg": "ini", ".yaml": "yaml", ".yml": "yaml", ".env": "env",
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".xml": "xml", ".lua": "lua",
}
#: In order; the first that fits gives the class.
CLASSES: list[tuple[str, str]] = [
    ("**/node_modules/**", "vendored"), ("**/vendor/**", "vendored"), ("**/third_party/**", "vendored"), ("**/*.min.js", "generated"), ("**/*_pb2.py", "generated"), ("**/*.lock", "lockfile"), ("**/package-lock.json", "lockfile"),
    ("**/fixtures/**", "fixture"), ("**/testdata/**", "fixture"), ("**/tests/e2e/**", "test_e2e"), ("**/tests/integration/**", "test_integration"), ("**/conftest.py", "test_support"),
    ("**/tests/**", "test_unit"), ("**/test/**", "test_unit"), ("**/test_*.py", "test_unit"), ("**/*_test.py", "test_unit"), ("**/*_test.go", "test_unit"), ("**/*.test.ts", "test_unit"), ("**/*.spec.ts", "test_unit"),
    ("**/adr/**", "architecture"), ("**/architecture/**", "architecture"), ("**/docs/**", "documentation"), ("**/*.md", "documentation"), ("**/*.rst", "documentation"),
    ("**/migrations/**", "migration"), ("**/scripts/**", "script"), ("**/Makefile", "build"), ("**/Dockerfile", "build"), ("**/pyproject.toml", "build"), ("**/setup.py", "build"), ("**/package.json", "build"),
    ("**/*.toml", "config"), ("**/*.ini", "config"), ("**/*.cfg", "config"), ("**/*.yaml", "config"), ("**/*.yml", "config"), ("**/*.json", "config"), ("**/*.env", "config"),
]


def list_tree(root: str, exclude: list[str] | None = None) -> list[str]:
    """Relative paths of all files below root, sorted: links are not followed, excluded folders not entered, nothing below MAX_DEPTH.

    Spark's own readers pass over empty files and names that begin with a mark, which source trees are full of.
    """
    import os
    import re

    if "://" in root and not root.startswith("file://"):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        return sorted(x.path[len(base) :].lstrip("/") for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File)
    pruned = [re.compile(globs.glob_regex(g)) for g in (EXCLUDE if exclude is None else exclude)]
    base, found = root.removeprefix("file://"), []
    pending = [("", 1)]
    while pending:
        at, depth = pending.pop()
        try:
            entries = list(os.scandir(os.path.join(base, at)))
        except OSError:
            continue
        for entry in entries:
            path = f"{at}/{entry.name}" if at else entry.name
            if entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                if depth < MAX_DEPTH and not any(p.match(path) for p in pruned):
                    pending.append((path, depth + 1))
            elif entry.is_file(follow_symlinks=False):
                found.append(path)
    return sorted(found)


def tree_stamp(root: str, exclude: list[str] | None = None) -> str:
    """A hash of the paths, sizes and times of change of a tree's files: equal as long as nobody has written to it."""
    import hashlib
    import os

    if "://" in root and not root.startswith("file://"):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        rows = [(x.path, x.size, x.mtime_ns) for x in system.get_file_info(fs.FileSelector(base, recursive=True))]
    else:
        base, rows = root.removeprefix("file://"), []
        for path in list_tree(root, exclude):
            try:
                found = os.stat(os.path.join(base, path))
                rows.append((path, found.st_size, found.st_mtime_ns))
            except OSError:  # it went meanwhile
                rows.append((path, -1, 0))
    return hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, cap: int = MAX_BYTES) -> DataFrame:
    """(path, content, byte_size) of all files below root; of files over the cap the first bytes, of unreadable ones null.

    The driver lists names; tasks read. A table of (path, content, byte_size) from elsewhere serves the index as well.
    """
    paths = list_tree(root, exclude)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 64 + 1, 4 * spark.sparkContext.defaultParallelism)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        remote = "://" in root
        system, base = fs.FileSystem.from_uri(root) if remote else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_file(f"{base.rstrip('/')}/{path}") as data:
                        size, content = data.size(), data.read(cap)
                except OSError:
                    size, content = 0, None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([size], pa.int64())], ["path", "content", "byte_size"])

    return rows.mapInArrow(run, "path string, content binary, byte_size long")


def discover(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, ignore: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Files inside the globs, not deeper than MAX_DEPTH and not ignored."""
    path = F.col("path")
    kept = globs.included(path, include or ["**"], EXCLUDE if exclude is None else exclude) & (F.size(F.split(path, "/")) <= MAX_DEPTH)
    return files.where(kept & ~globs.is_ignored(path, ignore or []))


def is_binary(content: str, head: int = HEAD) -> Column:
    return F.expr(f"position(X'00' IN substring({content}, 1, {head})) > 0")


def readable_text(content: Column) -> Column:
    """Lossy UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def described(files: DataFrame) -> DataFrame:
    """path, content_text, language, file_class, byte_size, line_count, source_hash, parse_state.

    Files that can't be read fail with one and the same hash, so that they don't count as changed again and again.
    """
    content, path, size = F.col("content"), F.col("path"), F.col("byte_size")
    binary, body = F.coalesce(is_binary("content"), F.lit(False)), F.coalesce(readable_text(content), F.lit(""))
    head = F.make_valid_utf8(F.substring(content, 1, 2048).cast("string"))
    state = F.when(content.isNull(), "failed").when(binary, "binary").when(size > MAX_BYTES, "oversized").otherwise("pending")
    shown = F.when(state == "pending", body).otherwise(F.lit(""))
    return files.select(
        "path", shown.alias("content_text"), language_of(path, EXTENSIONS).alias("language"), F.when(binary, F.lit("binary")).otherwise(globs.classify(path, CLASSES, "source", F.coalesce(head, F.lit("")))).alias("file_class"), size.alias("byte_size"),
        F.when(shown == "", F.lit(0)).otherwise(F.length(shown) - F.length(F.replace(shown, F.lit("\n"))) + F.when(shown.endswith("\n"), 0).otherwise(1)).alias("line_count"),
        F.coalesce(F.sha2(F.concat(content, size.cast("string").cast("binary")), 256), F.lit("unreadable")).alias("source_hash"), state.alias("parse_state"),
    )


def lines(files: DataFrame, text: str = "content_text") -> DataFrame:
    """(path, line, line_text), from 1; all kinds of line ends count."""
    split = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", ""), "\n")
    return files.where(F.col(text) != "").select("path", F.posexplode(split).alias("_at", "line_text")).select("path", (F.col("_at") + 1).alias("line"), "line_text")


def search_lines(numbered: DataFrame, patterns: list[str], ignore_case: bool = False, whole_words: bool = False, literal: bool = False, most_columns: int = 500) -> DataFrame:
    """Lines that match any of the patterns, with the submatches: one alternation, one pass."""
    import re

    each = [re.escape(p) if literal else p for p in patterns]
    joined = "|".join(f"(?:{p})" for p in each)
    joined = ("(?i)" if ignore_case else "") + (rf"\b(?:{joined})\b" if whole_words else f"(?:{joined})")
    hit = numbered.where(F.col("line_text").rlike(joined))
    return hit.select("path", "line", F.substring("line_text", 1, most_columns).alias("line_text"), F.regexp_extract_all("line_text", F.lit(f"({joined})"), F.lit(1)).alias("matches"))


def _inside(path: str) -> str:
    """The path, if it stays in the repository."""
    if path.startswith(("/", "~")) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("path leaves the repository")
    return path


def stat(files: DataFrame, path: str) -> DataFrame:
    """What is known of a file without its text: size, lines, class, language, hash, state; no row if it isn't there."""
    return files.where(F.col("path") == _inside(path)).select("path", "byte_size", "line_count", "file_class", "language", "source_hash", "parse_state")


def patch(root: str, path: str, text: str, first: int | None = None, last: int | None = None) -> dict:
    """Puts text in the place of a file, or of its lines first to last, by an atomic write. Gives back what undo needs."""
    import os

    from .suites import write_atomic

    place = os.path.join(root, _inside(path))
    before = open(place, encoding="utf-8", newline="").read() if os.path.exists(place) else None  # noqa: SIM115
    if first is not None:
        kept = (before or "").splitlines(keepends=True)
        if before is None or not 1 <= first <= (last or first) <= len(kept):
            raise ValueError("no such lines")
        text = "".join([*kept[: first - 1], text, *kept[last or first :]])
    os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
    write_atomic(place, text)
    return {"path": path, "before": before}


def undo(root: str, log: list[dict]) -> None:
    """Takes patches back, the last one first; files that a patch made go."""
    import os

    from .suites import write_atomic

    for entry in reversed(log):
        place = os.path.join(root, _inside(entry["path"]))
        if entry["before"] is None:
            os.remove(place)
        else:
            write_atomic(place, entry["before"])


def read_range(numbered: DataFrame, path: str, first: int, last: int) -> DataFrame:
    return numbered.where((F.col("path") == _inside(path)) & F.col("line").between(first, last)).orderBy("line")
