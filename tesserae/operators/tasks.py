"""Benchmark tasks: validation, gold sets, reduction of responses, capabilities, noise profiles, peaks, leaks, sequence numbers."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import redaction
from ..functions.text import normalize_path, normalize_symbol
from . import statistics

# Fixed values of the task format, as its rules name them.
CATEGORIES = ("symbol_location", "api_contract", "architecture", "behavior", "tests", "documentation", "comments", "configuration", "change_impact", "incremental")
DIFFICULTIES = ("L1", "L2", "L3", "L4", "L5")
PARAPHRASES = ("literal", "intent", "symptom")
TOOLS = ("candidate.search", "candidate.symbol", "candidate.context", "candidate.dependencies", "candidate.references", "candidate.tests", "candidate.docs", "repo.list", "repo.search", "repo.read", "repo.read_range", "repo.stat", "repo.patch")
LEAST_PROBES, LEAST_PARAPHRASES = 3, 3
GATE = 0.474
REPETITIONS = (1, 3, 5, 10)
#: operation: the list in its result and whether its rows name symbols.
RESULTS = {"search": ("hits", True), "get_symbol": ("symbols", True), "get_references": ("references", True), "get_tests": ("tests", False), "get_docs": ("docs", False)}


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _outside(c: Column | str, known: tuple[str, ...]) -> Column:
    return ~F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*known), F.lit(False))


def _some(c: str, test) -> Column:
    """How many elements of an array (null: none) pass."""
    return F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")) if c in ("required_capabilities", "allowed_tools") else F.col(c), test))


def validate(tasks: DataFrame, files: DataFrame | None = None, symbols: DataFrame | None = None, manifest: DataFrame | None = None, capabilities: tuple[str, ...] | None = None, released: bool = False) -> DataFrame:
    """(id, severity, code, n): how often each rule is broken by each task; a task that keeps all has no row.

    tasks: the columns of sources.suites.read_tasks, with stem (its file's name) if that is to be compared. files: path; symbols:
    qualified_name; manifest: corpus, commit. Rules about one task are columns of one pass; those about other tables are joins.
    """
    one = lambda wrong: wrong.cast("int")
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    probes, gold = F.coalesce(F.size("probes"), F.lit(0)), F.col("gold")
    rules: list[tuple[str, str, Column]] = [
        ("error", "id_missing", one(_blank("id"))), ("error", "category_invalid", one(_outside("category", CATEGORIES))), ("error", "difficulty_invalid", one(_outside("difficulty", DIFFICULTIES))), ("error", "prompt_empty", one(_blank("prompt"))),
        ("error", "probes_too_few", one(probes < LEAST_PROBES)), ("error", "paraphrases_too_few", one(size(F.array_distinct(F.transform("probes", lambda p: p["paraphrase_id"]))) < LEAST_PARAPHRASES)),
        ("error", "paraphrase_id_invalid", size(F.filter("probes", lambda p: _outside(p["paraphrase_id"], PARAPHRASES)))), ("error", "probe_op_missing", size(F.filter("probes", lambda p: F.coalesce(p["op"], F.lit("")) == ""))),
        ("error", "gold_empty", one((size(gold["files"]) == 0) & (size(gold["symbols"]) == 0))), ("error", "justification_missing", one(F.trim(F.coalesce(gold["justification"], F.lit(""))) == "")),
        ("error", "relationship_malformed", size(F.filter(gold["relationships"], lambda r: F.size(r) != 3))), ("error", "range_inverted", size(F.filter(gold["ranges"], lambda r: r["end"] < r["start"]))),
        ("error", "capabilities_missing", one(size(F.col("required_capabilities")) == 0)), ("error", "tools_unknown", one(_some("allowed_tools", lambda t: ~t.isin(*TOOLS)) > 0)),
        ("error" if released else "warning", "reviewed_by_missing", one(_blank("reviewed_by"))), ("warning", "authored_at_missing", one(_blank("authored_at"))),
    ]
    if "stem" in tasks.columns:
        rules.append(("error", "id_filename_mismatch", one(~F.col("id").eqNullSafe(F.col("stem")))))
    if capabilities is not None:
        rules.append(("error", "capabilities_unknown", one(_some("required_capabilities", lambda c: ~c.isin(*capabilities)) > 0)))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), n.cast("long").alias("n")) for s, c, n in rules)))
    out = tasks.select("id", each.alias("x")).select("id", "x.*").where("n > 0").groupBy("id", "severity", "code").agg(F.sum("n").alias("n"))
    told = lambda rows, code: rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit("error").alias("severity"), F.lit(code).alias("code"), "n")
    repeated = tasks.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").select("id", F.lit("error").alias("severity"), F.lit("id_duplicate").alias("code"), "n")
    out = out.unionByName(repeated)
    if manifest is not None:
        named = tasks.select("id", F.col("repository").alias("corpus"), "commit")
        out = out.unionByName(told(named.join(manifest.select("corpus").distinct(), "corpus", "left_anti"), "repository_unknown")).unionByName(told(named.join(manifest.select("corpus", "commit").distinct(), ["corpus", "commit"], "left_anti"), "commit_mismatch"))
    stale = None
    if files is not None:
        paths = tasks.select("id", F.explode(F.array_union(F.array_union(gold["files"], gold["tests"]), gold["docs"])).alias("path")).unionByName(tasks.select("id", F.explode(F.transform(gold["ranges"], lambda r: r["path"])).alias("path")))
        stale = paths.join(files.select("path").distinct(), "path", "left_anti").select("id")
    if symbols is not None:
        names = tasks.select("id", F.explode(F.array_distinct(gold["symbols"])).alias("qualified_name")).join(symbols.select("qualified_name").distinct(), "qualified_name", "left_anti").select("id")
        stale = names if stale is None else stale.unionByName(names)
    return out if stale is None else out.unionByName(told(stale, "stale_gold"))


def gold_set(tasks: DataFrame) -> DataFrame:
    """(id, kind, item), each once and normalized: symbols, and paths of files, tests, docs and ranges."""
    gold = F.col("gold")
    paths = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (gold["files"], gold["tests"], gold["docs"], F.transform(gold["ranges"], lambda r: r["path"]))))
    of = lambda kind, items, clean: tasks.select("id", F.lit(kind).alias("kind"), F.explode(F.transform(items, clean)).alias("item"))
    return of("symbol", gold["symbols"], normalize_symbol).unionByName(of("path", paths, normalize_path)).where("item <> ''").distinct()


def reduce_results(responses: DataFrame) -> DataFrame:
    """(probe, rank, symbol, path) of responses (probe, op, result as JSON): what each operation says is comparable to gold, in its own order.

    A context counts as one result. Tests and docs count by their path alone.
    """
    row = "array<struct<symbol:string,path:string>>"
    schema = ", ".join(f"{name} {row}" for name, _ in RESULTS.values()) + ", symbol string, path string"
    said = responses.withColumn("_r", F.from_json("result", schema))
    items = F.array().cast(row)
    for op, (name, named) in RESULTS.items():
        symbol = (lambda x: F.nullif(x["symbol"], F.lit(""))) if named else (lambda x: F.lit(None).cast("string"))
        found = F.transform(F.col(f"_r.{name}"), lambda x: F.struct(symbol(x).alias("symbol"), x["path"].alias("path")))  # noqa: B023  used at once
        items = F.when(F.col("op") == op, found).otherwise(items)
    context = F.when(F.coalesce(F.col("_r.symbol"), F.lit("")) != "", F.array(F.struct(F.col("_r.symbol").alias("symbol"), F.col("_r.path").alias("path"))))
    items = F.when(F.col("op") == "get_context", context).otherwise(items)
    return said.select("probe", F.posexplode(items).alias("_at", "_x")).select("probe", (F.col("_at") + 1).alias("rank"), "_x.symbol", "_x.path")


def capabilities_of(tasks: DataFrame) -> DataFrame:
    """(id, capability): what a task's probes need, each operation being a capability of its name."""
    return tasks.select("id", F.explode(F.array_distinct(F.transform("probes", lambda p: p["op"]))).alias("capability")).where("capability <> ''")


def lacking(required: DataFrame, offered: DataFrame) -> DataFrame:
    """(id, candidate, missing): the capabilities of a task (id, capability) that a candidate (candidate, capability) does not offer."""
    want = required.join(F.broadcast(offered.select("candidate").distinct()))  # a row for each candidate of a comparison
    return want.join(offered, ["candidate", "capability"], "left_anti").groupBy("id", "candidate").agg(F.array_sort(F.collect_set("capability")).alias("missing"))


def profile_key(suite: str, harness: str, model: str, settings: str) -> str:
    """A noise profile holds for one configuration."""
    return "np_" + hashlib.blake2b("|".join([suite, harness, model, settings]).encode(), digest_size=4).hexdigest()


def noise_profile(values: DataFrame, key: str, value: str, profile: str) -> DataFrame:
    """The dispersion of each metric over repetitions with the smallest effects that so many repetitions would show."""
    found = statistics.dispersion(values, key, value)
    effects = {f"mde_{n}": F.round(F.when(F.col("stdev") <= 0, 0.0).otherwise(statistics.detectable_effect(F.col("stdev"), n)), 6) for n in REPETITIONS}
    return found.withColumns(effects).withColumn("profile", F.lit(profile))


def discrimination_gate(values: DataFrame, metric: str, group: str, value: str, gate: float = GATE) -> DataFrame:
    """(metric, pairs, apart, largest, passes): whether any two groups differ in a metric by an effect of that size at least."""
    by = values.withColumn("_group", F.struct(F.col(metric).alias("m"), F.col(group).alias("g")))
    deltas = statistics.cliffs_delta(by, "_group", value).where("left.m = right.m and left.g < right.g")
    return deltas.groupBy(F.col("left.m").alias(metric)).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.abs("delta") >= gate).alias("apart"), F.max(F.abs("delta")).alias("largest")).withColumn("passes", F.col("largest") >= gate)


def peak_resources(samples: DataFrame, run: str, at: str, memory: str, cpu: str) -> DataFrame:
    """(run, peak_memory, cpu, samples): the largest sum over a sample's processes, and the largest CPU time of all of them."""
    each = samples.groupBy(run, at).agg(F.sum(memory).alias("m"), F.sum(cpu).alias("c"))
    return each.groupBy(run).agg(F.max("m").alias("peak_memory"), F.max("c").alias("cpu"), F.count(F.lit(1)).alias("samples"))


def leaks(tables: dict[str, DataFrame], threshold: float = 4.0) -> DataFrame:
    """(table, column, leaks): cells of every text column of every table that hold a known shape of a secret or a token with a provider's prefix."""
    pattern = "|".join([*redaction.VALUE_PATTERNS, *(rf"(?<![A-Za-z0-9]){p}[A-Za-z0-9_.-]{{8,}}" for p in redaction.SECRET_PREFIXES)])
    counts = []
    for name, table in tables.items():
        columns = [f.name for f in table.schema if f.dataType.typeName() == "string"]
        if columns:
            one = table.agg(*(F.count_if(F.col(c).rlike(pattern)).alias(c) for c in columns))
            counts.append(one.unpivot([], columns, "column", "leaks").select(F.lit(name).alias("table"), "column", "leaks"))
    return reduce(DataFrame.unionByName, counts)


def numbered(events: DataFrame, run: str, order: list[str], last: DataFrame | None = None) -> DataFrame:
    """events with seq, rising by one within each run; last (run, seq) is where earlier batches ended."""
    at = F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long")
    if last is None:
        return events.withColumn("seq", at)
    return events.withColumn("_at", at).join(last.groupBy(run).agg(F.max("seq").alias("_last")), run, "left").withColumn("seq", F.col("_at") + F.coalesce("_last", F.lit(0))).drop("_at", "_last")
