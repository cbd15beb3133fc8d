"""Task suites, corpus manifests and run artifacts."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TASK = (
    "id string, version int, repository string, commit string, category string, difficulty string, authored_by string, reviewed_by string, authored_at string, tags array<string>, prompt string, "
    "probes array<struct<paraphrase_id:string,op:string,args:map<string,string>>>, "
    "gold struct<files:array<string>,symbols:array<string>,tests:array<string>,docs:array<string>,ranges:array<struct<path:string,start:int,end:int>>,relationships:array<array<string>>,justification:string>, "
    "required_capabilities array<string>, allowed_tools array<string>, limits struct<max_tool_calls:int,max_repository_tokens:int,wall_clock_s:double>"
)
EVENT = "seq bigint, run_id string, kind string, component string, task_id string, ts double, payload string"
LEDGER = "seq bigint, task_id string, tool string, bucket string, tokens int, bytes int, approximate boolean, counted_in_metric boolean"
ARTIFACTS = ("manifest.json", "config.json", "tasks.jsonl", "events.jsonl", "ledger.jsonl", "calls.jsonl", "access.jsonl", "failures.jsonl", "resources.jsonl", "metrics.json", "summary.json")


def _task(data: dict) -> dict:
    gold = data.get("gold", {})
    return {
        **{k: data.get(k) for k in ("id", "version", "repository", "commit", "category", "difficulty", "authored_by", "reviewed_by", "prompt", "limits")},
        "authored_at": str(data["authored_at"]) if "authored_at" in data else None,
        **{k: list(data.get(k, [])) for k in ("tags", "required_capabilities", "allowed_tools")},
        "probes": [{"paraphrase_id": p.get("paraphrase_id"), "op": p.get("op"), "args": {k: v if isinstance(v, str) else json.dumps(v) for k, v in p.get("args", {}).items()}} for p in data.get("probes", [])],
        "gold": {**{k: list(gold.get(k, [])) for k in ("files", "symbols", "tests", "docs", "relationships")}, "ranges": gold.get("ranges", []), "justification": gold.get("justification")},
    }


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """All task files of a suite's folder, by id. Unknown fields raise ValueError."""
    known = {x.split()[0] for x in TASK.split(", ") if " " in x} | {"id"}
    tasks = []
    for path in sorted(Path(folder).rglob("*.toml")):
        data = tomllib.loads(path.read_text())
        if "id" not in data:
            continue
        if unknown := set(data) - known:
            raise ValueError(f"{path.name}: unknown fields {sorted(unknown)}")
        tasks.append(_task(data))
    return spark.createDataFrame(sorted(tasks, key=lambda t: t["id"]), TASK)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, commit, root) of pinned corpora."""
    data = tomllib.loads(Path(path).read_text())
    rows = [(k, v.get("commit"), v.get("root") or v.get("path")) for k, v in sorted(data.get("corpus", data).items()) if isinstance(v, dict)]
    return spark.createDataFrame(rows, "corpus string, commit string, root string")


class RunFolder:
    """An immutable run: named artifacts, written once, then sealed."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def write(self, name: str, rows: list[dict] | dict) -> None:
        if name not in ARTIFACTS:
            raise ValueError(f"no such artifact: {name}")
        if (self.folder / ".sealed").exists() or (self.folder / name).exists():
            raise FileExistsError(name)
        self.folder.mkdir(parents=True, exist_ok=True)
        said = "".join(json.dumps(r, sort_keys=True) + "\n" for r in rows) if isinstance(rows, list) else json.dumps(rows, sort_keys=True, indent=1)
        write_atomic(str(self.folder / name), said)

    def seal(self) -> None:
        write_atomic(str(self.folder / ".sealed"), "")

    def read(self, spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema).option("mode", "FAILFAST")
        return reader.json(str(self.folder / name), multiLine=not name.endswith("l"))


def write_atomic(path: str, text: str) -> None:
    """All of the file or none of it."""
    aside = f"{path}.tmp-{os.getpid()}"
    Path(aside).write_text(text)
    os.replace(aside, path)


def mirror_run(metrics: DataFrame, index: str) -> None:
    """Puts a run's metrics into the index of runs: its own partition alone is replaced."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(index)
