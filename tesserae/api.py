"""The eleven operations over an index, as calls and as JSON lines."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import indexer
from .config import Config
from .functions import text
from .operators import budget, resolve, search
from .render import RENDERERS
from .sources.files import tree_stamp
from .sources.generations import Generations

PROTOCOL = 1
OPS = ("prepare_repository", "search", "get_symbol", "get_context", "get_dependencies", "get_references", "get_tests", "get_docs", "update_repository", "get_stats", "shutdown")
#: What a context is filled with first.
CONTEXT_ORDER = ("purpose", "invariant", "security", "warning", "decision", "raises", "returns", "side_effect", "config", "env", "assertion", "call", "default", "literal")
#: Rows of a list in an answer at most.
MOST_ROWS = 500
REFERENCE_KINDS = ["CALLS", "EXTENDS", "USES_TYPE", "REFERENCES", "MOCKS", "IMPORTS"]
DOC_CLASSES = ["documentation", "architecture"]


class BadRequest(ValueError):
    """An argument that is missing or out of bounds."""


class NotPrepared(RuntimeError):
    """There is no index yet."""


def approximate_tokens(said: str) -> int:
    return max(1, int(len(said) * 0.27) + 1)


def _text(value: object, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise BadRequest(f"{name} must be a non-empty string")
    return value


def _limit(value: object, default: int) -> int:
    value = default if value is None else value
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= 500:
        raise BadRequest("limit must be a number from 1 to 500")
    return value


class Engine:
    """Queries of one index. Each operation is one plan; only its few result rows come to the driver."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.config, self.store, self.root = spark, config or Config(), Generations(spark, folder), None
        self.stamp: str | None = None

    def heal(self) -> bool:
        """Brings the index up to the tree if files were written, added or removed since the last look. Without a root or an index there is nothing to do."""
        if not self.root or not self.store.has("files"):
            return False
        now = tree_stamp(self.root, self.config["general.exclude"])
        if now == self.stamp:
            return False
        indexer.update(self.spark, self.root, self.store, self.config)
        self.stamp = now
        return True

    def table(self, name: str) -> DataFrame:
        if not self.store.has(name):
            raise NotPrepared("prepare_repository comes first")
        return self.store.read(name)

    def prepare_repository(self, root: str) -> dict:
        self.root = _text(root, "root")
        self.stamp = tree_stamp(self.root, self.config["general.exclude"])
        self.store = indexer.build(self.spark, self.root, self.store.folder, self.config)
        return {"files": self.table("files").count(), "symbols": self.table("symbols").count(), "generation": self.store.state()["generation"]}

    def update_repository(self, root: str | None = None) -> dict:
        self.root = root or self.root
        if not self.root:
            raise NotPrepared("prepare_repository comes first")
        self.stamp = tree_stamp(self.root, self.config["general.exclude"])
        counts = indexer.update(self.spark, self.root, self.store, self.config)
        return {"files_reparsed": counts.get("new", 0) + counts.get("changed", 0), "files_skipped": counts.get("unchanged", 0), "files_removed": counts.get("removed", 0), "generation": self.store.state()["generation"]}

    def terms(self, query: str) -> list[str]:
        return self.spark.range(1).select(text.query_terms(F.lit(query))).first()[0]

    def search_rows(self, query: str, limit: int, classes: list[str] | None = None) -> DataFrame:
        """doc_kind, doc_id, path, symbol, total: BM25 over the indexed columns, re-ranked and spread over paths.

        All hits are ranked again: the name that was asked for may have thousands before it that only begin with it.
        """
        asked = self.terms(_text(query, "query"))
        docs = self.table("search_docs")
        if classes:
            docs = docs.where(F.col("klass").isin(classes))
        columns = ["path", "symbol", "qualified", "signature", "keywords", "facts", "role", "klass"]
        phrases = [p for t in asked if (p := [w for w in t.split("_") if w])]
        hits = search.bm25(docs, text.spaced_words(F.concat_ws(" ", *columns)), phrases)
        low = lambda c: F.transform(text.split_identifier(c), F.lower)
        ranked = search.rerank(hits, asked or [""], low(F.col("symbol")), F.col("qualified"), low(F.regexp_replace("path", "/", "_")), F.split("keywords", " "), F.col("klass"))
        return search.diversify(ranked, "path", ["path", "doc_id", "doc_kind"], limit, self.config["search.per_path"])

    def search(self, query: str, limit: int | None = None) -> dict:
        n = _limit(limit, self.config["search.limit"])
        lines = self.table("symbols").select(F.col("stable_key").alias("doc_id"), "line_start", "qualified_name")
        rows = self.search_rows(query, n).join(lines, "doc_id", "left").orderBy(F.col("in_path") > self.config["search.per_path"], F.desc("total"), "path", "doc_id").collect()
        return {"hits": [{"path": r["path"], "symbol": r["qualified_name"], "line": r["line_start"] or 1, "score": r["total"]} for r in rows]}

    def _named(self, symbol: str) -> DataFrame:
        s = F.lit(_text(symbol, "symbol"))
        return self.table("symbols").where(text.names_match(s, F.col("name"), F.col("qualified_name")))

    def get_symbol(self, symbol: str, limit: int | None = None) -> dict:
        rows = self._named(symbol).orderBy("qualified_name", "stable_key").limit(_limit(limit, self.config["limits.symbols"])).collect()
        return {"symbols": [{"symbol": r["qualified_name"], "kind": r["kind"], "path": r["path"], "line_start": r["line_start"], "line_end": r["line_end"], "signature": r["signature"], "doc": r["doc"].split("\n")[0][:200]} for r in rows]}

    def get_context(self, symbol: str, max_tokens: int | None = None) -> dict:
        """The symbol and, within a budget, what is known about it: never its body."""
        n = _limit(max_tokens, min(500, self.config["budget.context_tokens"])) if max_tokens is not None else self.config["budget.context_tokens"]
        found = self._named(symbol).orderBy("qualified_name", "stable_key").limit(1)
        order = F.array_position(F.array(*map(F.lit, CONTEXT_ORDER)), F.col("kind"))
        facts = self.table("facts").join(found.select(F.col("stable_key").alias("symbol_key")), "symbol_key", "left_semi").where(order > 0)
        items = facts.select(order.alias("at"), "priority", (-F.col("confidence")).alias("doubt"), "kind", "value").distinct().withColumn("cost", text.candidate_tokens(F.col("value")))
        gathered = items.agg(F.array_sort(F.collect_list(F.struct("priority", "doubt", "at", "kind", "value", "cost"))).alias("items"))  # one symbol's facts
        row = gathered.select(budget.admit_greedy(F.transform("items", lambda x: F.struct(x["cost"], x["kind"], F.concat_ws("\x1f", x["kind"], x["value"]).alias("value"))), n, {}, self.config["budget.kind_cap"]).alias("got"), F.size("items").alias("n")).first()
        head = found.first()
        if head is None:
            return {"symbol": None, "items": [], "dropped": 0}
        admitted = [dict(zip(("kind", "value"), x.split("\x1f", 1), strict=True)) for x in row["got"]["admitted"]]
        return {"symbol": head["qualified_name"], "path": head["path"], "signature": head["signature"], "items": admitted, "tokens": row["got"]["used"], "dropped": row["n"] - len(admitted)}

    def get_dependencies(self, path: str) -> dict:
        p = _text(path, "path")
        imports = self.table("imports")
        own = imports.where(F.col("path") == p).select("resolved_module", "target_path").distinct().orderBy("resolved_module").limit(MOST_ROWS + 1).collect()
        back = imports.where(F.col("target_path") == p).select("path").distinct().orderBy("path").limit(MOST_ROWS + 1).collect()
        more = {"dropped": 1} if max(len(own), len(back)) > MOST_ROWS else {}  # a list goes on
        own, back = own[:MOST_ROWS], back[:MOST_ROWS]
        return more | {"imports_local": [r["target_path"] for r in own if r["target_path"]], "imports_external": [r["resolved_module"] for r in own if not r["target_path"]], "imported_by": [r["path"] for r in back]}

    def _referrers(self, symbol: str, kinds: list[str]) -> DataFrame:
        asked = self._named(symbol).select(F.col("stable_key").alias("target"))
        sources = self.table("symbols").select(F.col("stable_key").alias("symbol"), "path", "qualified_name")
        edges = self.table("relationships").drop("path").join(asked, "target", "left_semi")
        return resolve.reverse_references(edges, sources, kinds)

    def get_references(self, symbol: str, limit: int | None = None) -> dict:
        rows = self._referrers(symbol, REFERENCE_KINDS).orderBy(F.desc("confidence"), "source_path", "line", "qualified_name").limit(_limit(limit, self.config["limits.references"])).collect()
        return {"references": [{"path": r["source_path"], "line": r["line"], "symbol": r["qualified_name"], "kind": r["kind"], "confidence": r["confidence"], "tier": r["tier"]} for r in rows]}

    def get_tests(self, symbol: str, limit: int | None = None) -> dict:
        n = _limit(limit, self.config["limits.tests"])
        rows = self._referrers(symbol, ["TESTS", "COVERS"]).select("source_path", "qualified_name").distinct().orderBy("source_path", "qualified_name").limit(n).collect()
        if not rows:  # by words, in test files
            classes = [r["klass"] for r in self.table("search_docs").where("klass like 'test%'").select("klass").distinct().collect()]
            rows = [{"source_path": r["path"], "qualified_name": r["qualified"]} for r in self.search_rows(symbol, n, classes).collect()] if classes else []
        return {"tests": [{"path": r["source_path"], "symbol": r["qualified_name"]} for r in rows]}

    def get_docs(self, query: str, limit: int | None = None) -> dict:
        rows = self.search_rows(query, _limit(limit, self.config["limits.docs"]), DOC_CLASSES).collect()
        return {"docs": [{"path": r["path"], "section": r["qualified"], "score": r["total"]} for r in rows]}

    def get_stats(self) -> dict:
        state = self.store.state()
        rates = {r["tier"]: r["rate"] for r in resolve.tier_rates(self.table("relationships")).collect()}
        return {"generation": state["generation"], "idf_generation": state["idf_generation"], "index_bytes": self.store.size(), "tier_rates": rates, **{t: self.table(t).count() for t in ("files", "symbols", "facts", "relationships", "keywords")}}

    def shutdown(self) -> dict:
        return {"ok": True}

    def handle(self, line: str) -> str:
        """A request line to a response line: errors become envelopes, never exceptions."""
        began, request = time.perf_counter(), {}
        try:
            request = json.loads(line)
            if not isinstance(request, dict) or not isinstance(request.get("args", {}), dict):
                raise BadRequest("a request is an object with args")
            op = request.get("op")
            if request.get("protocol", PROTOCOL) != PROTOCOL:
                return self._said(request, began, error=("unsupported_protocol", f"this is protocol {PROTOCOL}"))
            if op not in OPS:
                return self._said(request, began, error=("unsupported_op", f"no such operation: {op}"))
            if op not in ("prepare_repository", "update_repository", "shutdown"):
                self.heal()
            return self._said(request, began, result=getattr(self, op)(**request.get("args", {})))
        except (json.JSONDecodeError, BadRequest, TypeError) as error:
            return self._said(request if isinstance(request, dict) else {}, began, error=("invalid_request", str(error)))
        except NotPrepared as error:
            return self._said(request, began, error=("not_prepared", str(error)))
        except Exception as error:  # noqa: BLE001
            return self._said(request, began, error=("internal", f"{type(error).__name__}: {str(error)[:200]}"))

    def _said(self, request: dict, began: float, result: dict | None = None, error: tuple[str, str] | None = None) -> str:
        state = self.store.state()
        out: dict = {"id": request.get("id"), "op": request.get("op"), "ok": error is None}
        if error:
            out["error"] = {"code": error[0], "message": error[1]}
        else:
            shape: Callable[[dict], str] | None = RENDERERS.get(request.get("format", "json"))
            out["result"] = result if shape is None or request.get("format", "json") == "json" else shape(result or {})
            said = json.dumps(result, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out["meta"] = {"tokens_approx": approximate_tokens(said), "truncated": bool((result or {}).get("dropped")), "dropped": (result or {}).get("dropped", 0), "index_state": "ready" if state["tables"] else "empty", "generation": state["generation"], "idf_generation": state["idf_generation"], "elapsed_ms": round((time.perf_counter() - began) * 1000, 3)}
        return json.dumps(out, sort_keys=True, ensure_ascii=False)


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            print(engine.handle(line), file=out, flush=True)
            if '"shutdown"' in line and json.loads(line).get("op") == "shutdown":
                return


def main(arguments: list[str] | None = None) -> None:
    """sync | update | verify | stats | search | context | symbol | references | tests | docs | render | serve, over an index folder."""
    import argparse

    parser = argparse.ArgumentParser(prog="tesserae")
    parser.add_argument("verb", choices=["sync", "update", "verify", "stats", "search", "context", "symbol", "references", "tests", "docs", "dependencies", "render", "serve", "config"])
    parser.add_argument("subject", nargs="?", default="")
    parser.add_argument("--root", default=".")
    parser.add_argument("--index", default=".tesserae")
    parser.add_argument("--format", default="json", choices=sorted(RENDERERS))
    asked = parser.parse_args(arguments)
    if asked.verb == "config":
        config = Config()
        print("\n".join(config.explain(k) for k in sorted(config.values) if asked.subject in k))
        return
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    engine = Engine(spark, asked.index)
    engine.root = asked.root
    if asked.verb == "serve":
        serve(engine)
        return
    if asked.verb == "verify":
        print(json.dumps(indexer.verify(spark, asked.root, engine.store), default=str))
        return
    calls = {"sync": lambda: engine.prepare_repository(asked.root), "update": engine.update_repository, "stats": engine.get_stats, "search": lambda: engine.search(asked.subject), "context": lambda: engine.get_context(asked.subject), "symbol": lambda: engine.get_symbol(asked.subject), "references": lambda: engine.get_references(asked.subject), "tests": lambda: engine.get_tests(asked.subject), "docs": lambda: engine.get_docs(asked.subject), "dependencies": lambda: engine.get_dependencies(asked.subject), "render": lambda: file_view(engine, asked.subject)}
    if asked.verb not in ("sync", "update", "stats") and engine.store.has("files") and Path(asked.root).exists():
        engine.heal()
    print(RENDERERS[asked.format](calls[asked.verb]()))


def file_view(engine: Engine, path: str) -> dict:
    """One file with its symbols, facts, keywords and imports, MOST_ROWS of each at most."""
    of = lambda name, order: [r.asDict(recursive=True) for r in engine.table(name).where(F.col("path") == path).orderBy(*order).limit(MOST_ROWS).collect()]
    head = of("files", ["path"])
    return {**(head[0] if head else {"path": path}), "symbols": of("symbols", ["line_start", "stable_key"]), "facts": of("facts", ["priority", "kind", "value"]), "keywords": of("keywords", [F.desc("score"), "term"]), "imports": of("imports", ["line"])}


if __name__ == "__main__":
    main()
