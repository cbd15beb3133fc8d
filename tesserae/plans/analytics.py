"""Links, resolution, budgets, grading, statistics and incremental upkeep over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..indexer import stored
from ..operators import budget, grading, incremental, joins, ledger, resolve, search, statistics
from ._sql import words
from .tables import read, scratch

_HREF = 'href="([^"#?]*)'


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("at", "href"))


_LINKS = f"links AS (SELECT page_id, url, ord::INTEGER - 1 AS ord, href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1) AS ord FROM pages))"


def link_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as imports: local when a page's own path is meant, external by host otherwise, linked_by the other way round."""
    links = _links(spark, sf_dir)
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("to_page"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    first = pages.where("path <> ''").groupBy("path").agg(F.min("to_page").alias("to_page"))
    each = links.select("page_id", "href").distinct().join(first, F.col("href") == F.col("path"), "left")
    kind = F.when(F.col("to_page").isNotNull(), "local").when(F.col("href").rlike("^[a-z]+://"), "external").otherwise("unresolved")
    out = each.withColumn("kind", kind)
    by = out.groupBy("page_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("local", "external", "unresolved")))
    back = out.where("kind = 'local'").groupBy(F.col("to_page").alias("page_id")).agg(F.count_distinct("page_id").alias("linked_by"))
    return by.join(back, "page_id", "left").withColumn("linked_by", F.coalesce("linked_by", F.lit(0)))


LINK_DEPENDENCIES = f"""
WITH {_LINKS},
first AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, min(page_id) AS to_page FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) <> '' GROUP BY 1),
e AS (SELECT page_id, href, to_page, CASE WHEN to_page IS NOT NULL THEN 'local' WHEN regexp_matches(href, '^[a-z]+://') THEN 'external' ELSE 'unresolved' END AS kind
    FROM (SELECT DISTINCT page_id, href FROM links) LEFT JOIN first ON href = path),
b AS (SELECT to_page AS page_id, count(DISTINCT page_id) AS linked_by FROM e WHERE kind = 'local' GROUP BY to_page)
SELECT page_id, count(*) FILTER (kind = 'local')::BIGINT AS n_local, count(*) FILTER (kind = 'external')::BIGINT AS n_external, count(*) FILTER (kind = 'unresolved')::BIGINT AS n_unresolved, coalesce(any_value(linked_by), 0)::BIGINT AS linked_by
FROM e LEFT JOIN b USING (page_id) GROUP BY page_id
"""


def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view or signup of its user before each error or purchase."""
    events = read(spark, sf_dir, "events")
    mark = F.col("event_type").isin("view", "signup")
    told = joins.nearest_preceding(events, "user_id", ["ts", "event_id"], mark, {"before_id": F.col("event_id"), "before_type": F.col("event_type")})
    return told.where(F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "before_id", "before_type")


NEAREST_PRECEDING = """
WITH t AS (SELECT *, last_value(CASE WHEN event_type IN ('view', 'signup') THEN event_id END IGNORE NULLS) OVER w AS before_id, last_value(CASE WHEN event_type IN ('view', 'signup') THEN event_type END IGNORE NULLS) OVER w AS before_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, before_id, before_type FROM t WHERE event_type IN ('error', 'purchase')
"""


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines' dates lie inside the first 60 days: the range read covers the gold range."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("end"))
    gold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("gold_start"), F.max("l_shipdate").alias("gold_end"))
    return joins.contained_ranges(orders, gold, "key").select("key", F.date_diff("gold_end", "gold_start").alias("days"))


INTERVAL = """
WITH g AS (SELECT l_orderkey AS key, min(l_shipdate) AS gold_start, max(l_shipdate) AS gold_end FROM lineitem GROUP BY l_orderkey)
SELECT key, date_diff('day', gold_start::DATE, gold_end::DATE)::INTEGER AS days FROM orders JOIN g ON o_orderkey = key AND o_orderdate <= gold_start AND o_orderdate + INTERVAL 60 DAY >= gold_end
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Definitions: the words that open documents. References: the words that close them, looked up in the document, its source, everywhere."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", text.ascii_words("text").alias("w"))
    opens = docs.select("doc_id", "source", F.explode(F.array_distinct(F.filter(F.slice("w", 1, 3), lambda t: F.length(t) > 2))).alias("def_name"))
    definitions = opens.select(F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), "def_name").alias("symbol"), F.col("doc_id").alias("def_file"), "def_name", "source")
    last = F.when(F.size("w") > 4, F.slice("w", -4, 4)).otherwise(F.col("w"))
    refs = docs.select("doc_id", "source", F.explode(F.array_distinct(F.filter(last, lambda t: F.length(t) > 2))).alias("name"))
    refs = refs.select(F.concat_ws("#", F.col("doc_id").cast("string"), "name").alias("ref"), F.col("doc_id").alias("file"), "name", "source")
    return refs, definitions


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, definitions = _graph(spark, sf_dir)
    # a source's first definition of a name is in scope for the source's files
    exported = definitions.groupBy("source", "def_name").agg(F.min("symbol").alias("symbol"))
    scope = refs.select("file", "name", "source").join(exported.withColumnRenamed("def_name", "name"), ["source", "name"]).select("file", "name", "symbol")
    return resolve.resolve(refs.drop("source"), definitions.drop("source"), scope)


_W = words("text")
_GRAPH = f"""
d AS (SELECT doc_id, source, {_W} AS w FROM documents),
defs AS (SELECT lpad(doc_id::VARCHAR, 12, '0') || ':' || t AS symbol, doc_id AS def_file, t AS def_name, source FROM (SELECT doc_id, source, unnest(list_distinct(list_filter(list_slice(w, 1, 3), lambda t: length(t) > 2))) AS t FROM d)),
refs AS (SELECT doc_id::VARCHAR || '#' || t AS ref, doc_id AS file, t AS name, source FROM (SELECT doc_id, source, unnest(list_distinct(list_filter(CASE WHEN len(w) > 4 THEN w[-4:] ELSE w END, lambda t: length(t) > 2))) AS t FROM d)),
f AS (
    SELECT ref, min(symbol) AS target, 0 AS tier, 1.0::DOUBLE AS confidence FROM refs JOIN defs ON file = def_file AND name = def_name GROUP BY ref
    UNION ALL SELECT ref, min(symbol), 1, 0.9::DOUBLE FROM refs JOIN defs ON refs.source = defs.source AND name = def_name GROUP BY ref
    UNION ALL SELECT ref, symbol, CASE WHEN n = 1 THEN 2 ELSE 3 END, CASE WHEN n = 1 THEN 0.7 ELSE least(0.5, 1.0::DOUBLE / n) END::DOUBLE FROM refs JOIN (SELECT *, count(*) OVER (PARTITION BY def_name) AS n, row_number() OVER (PARTITION BY def_name ORDER BY symbol) AS ord FROM defs) ON name = def_name AND ord <= 3),
b AS (SELECT *, min(tier) OVER (PARTITION BY ref) AS best FROM f),
edges AS (SELECT refs.ref, refs.file, refs.name, b.target, 'R' || coalesce(b.tier, 4) AS tier, coalesce(b.confidence, 0.3)::DOUBLE AS confidence FROM refs LEFT JOIN b ON refs.ref = b.ref AND b.tier = b.best)
"""


def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("ref", "target", "tier", F.round("confidence", 6).alias("confidence"))


def tier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.tier_rates(_edges(spark, sf_dir))


def reverse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).where("target is not null")
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("file").alias("files"), F.round(F.max("confidence"), 6).alias("confidence"))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).where("target is not null").select(F.col("file").alias("source_file"), "target")
    _, definitions = _graph(spark, sf_dir)
    return resolve.fan_in(edges, definitions.select("symbol", F.col("def_file").alias("path"))).groupBy("target_file").agg(F.count(F.lit(1)).alias("referrers"))


def incremental_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References unresolved without the last tenth of documents that its names resolve."""
    refs, definitions = _graph(spark, sf_dir)
    late = F.col("def_file") % 10 == 9
    open_ = refs.join(definitions.where(~late).select(F.col("def_name").alias("name")).distinct(), "name", "left_anti")
    return resolve.promote(open_, definitions.where(late).select(F.col("def_name").alias("name"))).select("ref", "name")


def budget_admit_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation into 150 tokens, at most two of a role: the short ones first."""
    turns = read(spark, sf_dir, "conversations").withColumn("cost", text.quarter_tokens(F.coalesce("text", F.lit(""))))
    items = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("cost", "turn", F.col("role").alias("kind"), F.col("turn").cast("string").alias("value")))).alias("items"))
    told = items.withColumn("got", budget.admit_greedy(F.col("items"), 150, {"user": 2, "assistant": 2}, 1))
    return told.select("conv_id", F.col("got.used").alias("used"), F.array_join("got.admitted", ",").alias("admitted"), (F.size("items") - F.size("got.admitted")).alias("dropped"))


GREEDY = """
WITH RECURSIVE i AS (SELECT conv_id, role, turn, ceil(length(coalesce(text, '')) / 4.0)::INTEGER AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY ceil(length(coalesce(text, '')) / 4.0), turn, role) AS ord FROM conversations),
s AS (
    SELECT conv_id, 0::BIGINT AS ord, 0::INTEGER AS used, 0 AS u, 0 AS a, 0 AS o, ''::VARCHAR AS admitted, 0 AS n FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT s.conv_id, i.ord, used + CASE WHEN ok THEN cost ELSE 0 END, u + (ok AND role = 'user')::INTEGER, a + (ok AND role = 'assistant')::INTEGER, o + (ok AND role NOT IN ('user', 'assistant'))::INTEGER,
        CASE WHEN ok THEN CASE WHEN admitted = '' THEN turn::VARCHAR ELSE admitted || ',' || turn END ELSE admitted END, n + ok::INTEGER
    FROM s JOIN (SELECT * FROM i) i ON i.conv_id = s.conv_id AND i.ord = s.ord + 1, LATERAL (SELECT (CASE role WHEN 'user' THEN u < 2 WHEN 'assistant' THEN a < 2 ELSE o < 1 END) AND used + cost <= 150 AS ok))
SELECT conv_id, used, admitted, (ord - n)::INTEGER AS dropped FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ord DESC) = 1
"""


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("cost", text.quarter_tokens(F.coalesce("text", F.lit(""))).cast("long"))
    return budget.admit_prefix(turns, "conv_id", ["turn"], "cost", 300).groupBy("conv_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("dropped"), F.coalesce(F.max(F.when(F.col("admitted"), F.col("running"))), F.lit(0)).alias("used"))


BUDGET_PREFIX = """
WITH t AS (SELECT conv_id, turn, sum(ceil(length(coalesce(text, '')) / 4.0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations)
SELECT conv_id, count(*) FILTER (running <= 300)::BIGINT AS admitted, count(*) FILTER (running > 300)::BIGINT AS dropped, coalesce(max(running) FILTER (running <= 300), 0)::BIGINT AS used FROM t GROUP BY conv_id
"""


def running_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("cost", text.quarter_tokens(F.coalesce("text", F.lit(""))).cast("long"))
    return budget.within_limit(turns, "conv_id", "turn", "cost", 400).select("conv_id", "turn", "spent_before", "allowed")


RUNNING_LIMIT = """
WITH t AS (SELECT conv_id, turn, coalesce(sum(ceil(length(coalesce(text, '')) / 4.0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM conversations)
SELECT conv_id, turn, spent_before, spent_before < 400 AS allowed FROM t
"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    return docs.groupBy("lang").agg(F.sum(text.candidate_tokens(t)).alias("candidate"), F.sum(text.quarter_tokens(t)).alias("quarter"), F.sum(text.word_tokens(t)).alias("wordwise"))


TOKEN_COUNTS = r"""
WITH d AS (SELECT lang, coalesce(text, '') AS t FROM documents)
SELECT lang, sum(greatest(1, floor(length(t) * 0.27::DOUBLE)::INTEGER + 1))::BIGINT AS candidate, sum(ceil(length(t) / 4.0)::BIGINT)::BIGINT AS quarter,
    sum(coalesce(list_sum(list_transform(regexp_extract_all(t, '([A-Za-z0-9_]+|[^A-Za-z0-9_\s])', 1), lambda p: CASE WHEN length(p) <= 4 THEN 1 ELSE ceil(length(p) / 4.0)::INTEGER END)), 0) + length(t) - length(replace(t, chr(10), '')))::BIGINT AS wordwise
FROM d GROUP BY lang
"""


def _probe_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(probe, doc_id, c, gold): places of the item's third to fifth words in a row, and whether the document has its first eight words.

    Each text is walked once: every place meets both kinds of runs by its three words, and the few that met look at the five that follow.
    """
    run = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    wanted = items.select(F.col("item_id").alias("probe"), text.ascii_words("text").alias("w")).where(F.size("w") >= 8)
    asked = wanted.select("probe", run(3, 3).alias("gram"), F.lit(None).cast("string").alias("rest")).unionByName(wanted.select("probe", run(1, 3).alias("gram"), run(4, 5).alias("rest")))
    words = search.once(docs.select("doc_id", "text"), "w", text.ascii_words("text")).drop("text")
    places = words.select("doc_id", "w", F.explode(F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3))).alias("k"))
    met = places.withColumn("gram", F.concat_ws(" ", *(F.get("w", F.col("k") + i) for i in range(3)))).join(asked, "gram")
    follow = F.array_join(F.slice("w", F.col("k") + 4, 5), " ")
    return met.groupBy("probe", "doc_id").agg(F.count_if(F.col("rest").isNull()).alias("c"), F.max(F.coalesce(follow == F.col("rest"), F.lit(False))).alias("gold"))


def _probe_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Probes: benchmark items by their third to fifth words. Results: documents with these words in a row, ranked. Gold: documents with the item's first eight words. Both come from hits that are written once, however often a metric reads them."""
    hits = stored(_probe_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), scratch(spark))
    at = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("c"), "doc_id"))
    results = hits.where("c > 0").withColumn("rank", at).where("rank <= 10").select("probe", "rank", F.col("doc_id").alias("item"))
    return results, hits.where("gold").select("probe", F.col("doc_id").alias("item"))


_PROBES = f"""
d AS (SELECT doc_id, {_W} AS w FROM documents),
g3 AS (SELECT doc_id, g AS gram, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS g FROM d) GROUP BY doc_id, g),
g8 AS (SELECT DISTINCT doc_id, g AS gram FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM d)),
items AS (SELECT item_id AS probe, {_W} AS w FROM benchmark WHERE len({_W}) >= 8),
results AS (SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY c DESC, doc_id) AS rank, doc_id AS item FROM items JOIN g3 ON gram = array_to_string(w[3:5], ' ') QUALIFY rank <= 10),
gold AS (SELECT DISTINCT probe, doc_id AS item FROM items JOIN g8 ON gram = array_to_string(w[1:8], ' ')),
first AS (SELECT probe, item, min(rank) AS rank FROM results JOIN gold USING (probe, item) GROUP BY probe, item),
size AS (SELECT probe, count(DISTINCT item) AS n FROM gold GROUP BY probe),
by_probe AS (SELECT probe, {", ".join(f"count(*) FILTER (rank <= {a}) AS hit{a}, count(DISTINCT rank) FILTER (rank <= {a}) AS right{a}" for a in grading.AT)}, min(rank) AS best, sum(1 / log2(rank + 1)) AS gain FROM first GROUP BY probe),
metrics AS (SELECT probe, {", ".join(f"round(coalesce(hit{a} / n, 0.0::DOUBLE), 6) AS recall_at_{a}, round(coalesce(right{a} / {a}, 0.0::DOUBLE), 6) AS precision_at_{a}" for a in grading.AT)},
    round(coalesce(1 / best, 0.0::DOUBLE), 6) AS mrr, round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 0.0::DOUBLE), 6) AS ndcg FROM size LEFT JOIN by_probe USING (probe))
"""


def recall_precision_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.metrics(*_probe_results(spark, sf_dir))


def worst_case_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and worst values over a task's probes (five probes a task), per metric."""
    told = grading.metrics(*_probe_results(spark, sf_dir)).unpivot(["probe"], ["recall_at_5", "mrr", "ndcg"], "metric", "value")
    return grading.mean_and_worst(told.withColumn("task", F.floor(F.col("probe") / 5).cast("long")), "task", "metric", "value", "probe")


WORST_CASE = f"""
WITH {_PROBES},
v AS (UNPIVOT (SELECT probe, probe // 5 AS task, recall_at_5, mrr, ndcg FROM metrics) ON recall_at_5, mrr, ndcg INTO NAME metric VALUE value)
SELECT task, metric, round(avg(value), 6) AS mean, round(min(value), 6) AS worst, round(avg(value), 6) - round(min(value), 6) > 0.30 AS brittle FROM v GROUP BY task, metric
"""


def agent_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last answers against the words that end their questions: weights renormalized over what applies."""
    turns = read(spark, sf_dir, "conversations")
    by = turns.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    asked, said = text.ascii_words(F.coalesce("question", F.lit(""))), text.ascii_words(F.coalesce("answer", F.lit("")))
    rows = by.select("conv_id", F.array_distinct(F.slice(asked, 1, 5)).alias("symbols"), F.array_distinct(F.filter(asked, lambda t: F.length(t) > 8)).alias("files"), F.array_distinct(said).alias("said"))
    part = lambda c: F.when(F.size(c) > 0, F.size(F.array_intersect(c, "said")) / F.size(c))
    return rows.select("conv_id", F.round(grading.weighted_correctness({"symbols": (part("symbols"), 0.5), "files": (part("files"), 0.3)}), 6).alias("correctness"))


AGENT = f"""
WITH t AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS answer, arg_min(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, {words("coalesce(question, '')")} AS q, list_distinct({words("coalesce(answer, '')")}) AS said FROM t),
p AS (SELECT conv_id, said, list_distinct(list_slice(q, 1, 5)) AS s, list_distinct(list_filter(q, lambda x: length(x) > 8)) AS f FROM w),
v AS (SELECT conv_id, CASE WHEN len(s) > 0 THEN len(list_intersect(s, said)) / len(s) END AS vs, CASE WHEN len(f) > 0 THEN len(list_intersect(f, said)) / len(f) END AS vf FROM p)
SELECT conv_id, round(CASE WHEN vs IS NULL AND vf IS NULL THEN 0.0::DOUBLE ELSE (coalesce(vs, 0) * 0.5::DOUBLE + coalesce(vf, 0) * 0.3::DOUBLE) / ((vs IS NOT NULL)::INTEGER * 0.5::DOUBLE + (vf IS NOT NULL)::INTEGER * 0.3::DOUBLE) END, 6) AS correctness FROM v
"""


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumns({"tokens": text.quarter_tokens(F.coalesce("text", F.lit(""))), "size": F.octet_length(F.coalesce("text", F.lit("")))})
    return ledger.rollup(turns, "conv_id", F.when(F.col("role") == "assistant", "repository").otherwise("prompt"), F.col("turn") < 6, "tokens", "size")


LEDGER = """
WITH t AS (SELECT conv_id, role, turn, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens, strlen(coalesce(text, '')) AS size FROM conversations)
SELECT conv_id, count(*)::BIGINT AS interactions, sum(size)::BIGINT AS bytes, sum(CASE WHEN role = 'assistant' AND turn < 6 THEN tokens ELSE 0 END)::BIGINT AS repository_tokens, sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END)::BIGINT AS prompt_tokens FROM t GROUP BY conv_id
"""


def per_tool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    return ledger.per_tool(events, "event_type", F.col("value") > 10, "tokens")


PER_TOOL = "SELECT event_type, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM events WHERE value > 10 GROUP BY event_type"


def replay_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replay(read(spark, sf_dir, "events"), "event_type", ["click", "view"], "user_id", F.get_json_object("props", "$.k").cast("long"))


REPLAY = "SELECT user_id, count(*)::BIGINT AS events, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS used FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id"


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, ("timeout", "crash", "internal", "infra", "other"))), (F.col("event_id") % 5 + 1).cast("int")))
    told = events.withColumn("class", F.when(code.isNotNull(), ledger.classify_failure(code)).otherwise("none"))
    return ledger.run_summary(told, "user_id", F.col("class") != "none", F.col("class") == "infrastructure")


FAILURE_CLASSES = """
WITH c AS (SELECT user_id, event_type = 'error' AS failed, event_type = 'error' AND event_id % 5 = 3 AS infra FROM events)
SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (failed)::BIGINT AS failed, count(*) FILTER (infra)::BIGINT AS infra, count(*) FILTER (infra) / greatest(count(*), 1) > 0.05 AS degraded FROM c GROUP BY user_id
"""


def dispersion_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as repetitions of a measurement."""
    told = statistics.dispersion(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "l_quantity")
    return told.select("*", *(F.round(statistics.detectable_effect(F.col("stdev"), n), 6).alias(f"mde_{n}") for n in (1, 3, 5, 10)))


DISPERSION = """
WITH v AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS mean, median(l_quantity) AS median, coalesce(stddev_samp(l_quantity), 0.0) AS stdev, min(l_quantity) AS least, max(l_quantity) AS most, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE WHEN n < 4 THEN 0.0 ELSE list_median(v[n - n // 2 + 1:n]) - list_median(v[1:n // 2]) END::DOUBLE AS iqr, CASE WHEN mean = 0 THEN 0.0 ELSE stdev / abs(mean) END::DOUBLE AS cv FROM v)
SELECT l_orderkey, n::BIGINT AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(stdev, 6) AS stdev, round(iqr, 6) AS iqr, round(cv, 6) AS cv, round(least, 6) AS least, round(most, 6) AS most,
    CASE WHEN cv > 0.20 THEN 'unusable' WHEN cv > 0.05 THEN 'noisy' ELSE 'stable' END AS stability,
    round(2.80158::DOUBLE * round(stdev, 6) / sqrt(1), 6) AS mde_1, round(2.80158::DOUBLE * round(stdev, 6) / sqrt(3), 6) AS mde_3, round(2.80158::DOUBLE * round(stdev, 6) / sqrt(5), 6) AS mde_5, round(2.80158::DOUBLE * round(stdev, 6) / sqrt(10), 6) AS mde_10
FROM s
"""


def cliffs_delta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cliffs_delta(read(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 10).alias("v")), "o_orderpriority", "v")


CLIFFS = """
WITH o AS (SELECT o_orderpriority AS g, floor(o_totalprice / 10)::BIGINT AS v FROM orders), c AS (SELECT g, v, count(*) AS c FROM o GROUP BY g, v),
p AS (SELECT a.g AS "left", b.g AS "right", sum(a.c * b.c * (CASE WHEN a.v > b.v THEN 1 WHEN a.v < b.v THEN -1 ELSE 0 END))::DOUBLE / (sum(a.c * b.c))::DOUBLE AS delta FROM c a, c b WHERE a.g <> b.g GROUP BY a.g, b.g),
r AS (SELECT "left", "right", round(delta, 6) + 0.0::DOUBLE AS delta FROM p)
SELECT "left", "right", delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM r
"""


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices by order month, first against second half of the day-numbers: twelve paired differences a status."""
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", F.month("o_orderdate").alias("m"), F.when(F.dayofmonth("o_orderdate") <= 15, 1).otherwise(-1).alias("s"), F.floor("o_totalprice").cast("long").alias("v"))
    diffs = orders.groupBy("o_orderstatus", "m").agg(F.sum(F.col("s") * F.col("v")).cast("double").alias("d"))
    arrays = diffs.groupBy("o_orderstatus").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "d"))), lambda x: x["d"]).alias("d")).where(F.size("d") == 12)
    return statistics.permutation_test(arrays, "o_orderstatus", "d", 12)


PERMUTATION = """
WITH o AS (SELECT o_orderstatus, month(o_orderdate) AS m, sum(CASE WHEN day(o_orderdate) <= 15 THEN floor(o_totalprice) ELSE -floor(o_totalprice) END)::DOUBLE AS d FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderstatus, list(d ORDER BY m) AS d FROM o GROUP BY o_orderstatus HAVING count(*) = 12),
t AS (SELECT o_orderstatus, abs(list_sum(d)) AS seen, abs(list_sum(list_transform(range(0, 12), lambda i: CASE WHEN (s >> i) & 1 = 0 THEN d[i + 1] ELSE -d[i + 1] END))) AS total FROM a, (SELECT unnest(range(0, 4096)) AS s))
SELECT o_orderstatus, round(count(*) FILTER (total >= seen - 1e-12) / count(*), 6) AS p_value FROM t GROUP BY o_orderstatus
"""


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount and tax shares of parts as two candidates' scores."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_discount") * 10).alias("a"), F.avg(F.col("l_tax") * 10).alias("b"))
    return statistics.triage(lines.unpivot(["l_partkey"], ["a", "b"], "candidate", "value"), "l_partkey", "candidate", "value")


TRIAGE = """
WITH a AS (SELECT l_partkey, avg(l_discount * 10) AS a, avg(l_tax * 10) AS b FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, 2::BIGINT AS candidates, round(greatest(a, b) - least(a, b), 6) AS discrimination, CASE WHEN least(a, b) >= 0.95 THEN 'ceiling' WHEN greatest(a, b) <= 0.05 THEN 'floor' ELSE 'informative' END AS flag FROM a
"""


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over parts: those shipped by air (even lines) and by others."""
    lines = read(spark, sf_dir, "lineitem")
    run = lambda parity: lines.where(F.col("l_linenumber") % 2 == parity).groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return statistics.compare_runs(run(1), run(0), "l_partkey", "value")


COMPARE_RUNS = """
WITH a AS (SELECT l_partkey, sum(l_quantity::BIGINT) AS l FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity::BIGINT) AS r FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT count(*)::BIGINT AS shared, round(avg(l), 6) AS mean_left, round(avg(r), 6) AS mean_right, round(avg(r - l), 6) AS delta, count(*) FILTER (r > l)::BIGINT AS wins, count(*) > 0 AS comparable FROM a JOIN b USING (l_partkey)
"""


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of the documents' hashes: the old one lacks some rows and has others changed, the new one lacks others."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    old = docs.where(F.col("path") % 7 != 3).withColumn("hash", F.when(F.col("path") % 5 == 1, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash")))
    return old, docs.where(F.col("path") % 11 != 4)


_GENERATIONS = "docs AS (SELECT doc_id AS path, md5(text) AS hash FROM documents), old AS (SELECT path, CASE WHEN path % 5 = 1 THEN md5(hash || 'x') ELSE hash END AS hash FROM docs WHERE path % 7 <> 3), new AS (SELECT * FROM docs WHERE path % 11 <> 4)"


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.snapshot_diff(*_generations(spark, sf_dir), "path", "hash")


SNAPSHOT = f"""
WITH {_GENERATIONS} SELECT path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'removed' WHEN old.hash IS NOT DISTINCT FROM new.hash THEN 'unchanged' ELSE 'changed' END AS status FROM old FULL JOIN new USING (path)
"""


def verify_symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.symmetric_difference(*_generations(spark, sf_dir))


VERIFY = f"WITH {_GENERATIONS} SELECT *, 'missing' AS side FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'stale' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)"


def upsert_and_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old generation with changed and new rows put in and removed rows taken out: the new generation."""
    old, new = _generations(spark, sf_dir)
    status = incremental.snapshot_diff(old, new, "path", "hash")
    delta = new.join(status.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
    live = incremental.delete_cascade({"files": incremental.upsert(old, delta, ["path"])}, status.where("status = 'removed'").select("path"))
    return live["files"].select("path", "hash")


UPSERT = f"WITH {_GENERATIONS} SELECT path, hash FROM new"


def counters_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    count = lambda parity: events.where(F.col("event_id") % 2 == parity).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return incremental.accumulate(count(0), count(1))


COUNTERS = "SELECT event_type AS name, count(*)::BIGINT AS value FROM events GROUP BY event_type"

QUERIES = {
    "link_dependencies": (link_dependencies, LINK_DEPENDENCIES), "nearest_preceding": (nearest_preceding, NEAREST_PRECEDING), "interval_containment": (interval_containment, INTERVAL),
    "tiered_resolution": (tiered_resolution, f"WITH {_GRAPH} SELECT ref, target, tier, round(confidence, 6) AS confidence FROM edges"),
    "tier_rates": (tier_rates, f"WITH {_GRAPH} SELECT tier, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM edges), 6) AS rate FROM edges GROUP BY tier"),
    "reverse_references": (reverse_references, f"WITH {_GRAPH} SELECT target, count(*)::BIGINT AS refs, count(DISTINCT file)::BIGINT AS files, round(max(confidence), 6) AS confidence FROM edges WHERE target IS NOT NULL GROUP BY target"),
    "fan_in": (fan_in, f"WITH {_GRAPH} SELECT def_file AS target_file, count(DISTINCT file)::BIGINT AS referrers FROM edges JOIN defs ON target = symbol WHERE file <> def_file GROUP BY def_file"),
    "incremental_promote": (incremental_promote, f"WITH {_GRAPH} SELECT ref, name FROM refs WHERE name NOT IN (SELECT def_name FROM defs WHERE def_file % 10 <> 9) AND name IN (SELECT def_name FROM defs WHERE def_file % 10 = 9)"),
    "budget_admit_greedy": (budget_admit_greedy, GREEDY), "budget_prefix": (budget_prefix, BUDGET_PREFIX), "running_limit": (running_limit, RUNNING_LIMIT), "token_counts": (token_counts, TOKEN_COUNTS),
    "recall_precision_mrr_ndcg": (recall_precision_mrr_ndcg, f"WITH {_PROBES} SELECT * FROM metrics"), "worst_case_mean": (worst_case_mean, WORST_CASE), "agent_correctness": (agent_correctness, AGENT),
    "ledger_rollup": (ledger_rollup, LEDGER), "per_tool_totals": (per_tool_totals, PER_TOOL), "replay_usage": (replay_usage, REPLAY), "failure_classes": (failure_classes, FAILURE_CLASSES),
    "dispersion_mde": (dispersion_mde, DISPERSION), "cliffs_delta_matrix": (cliffs_delta_matrix, CLIFFS), "permutation_test": (permutation_test, PERMUTATION), "triage": (triage, TRIAGE), "compare_runs": (compare_runs, COMPARE_RUNS),
    "snapshot_diff": (snapshot_diff, SNAPSHOT), "verify_symmetric_diff": (verify_symmetric_diff, VERIFY), "upsert_and_cascade": (upsert_and_cascade, UPSERT), "counters_accumulate": (counters_accumulate, COUNTERS),
}
