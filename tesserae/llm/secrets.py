r"""Secret scans over a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression yields a Boolean trigram query.  The index holds,
for the trigrams that the rules ask for, the texts that have them; postings are
intersected to candidate (text, rule) pairs; candidates alone are verified by
the expression.  Rules that demand no trigram (runs of hex digits) scan all
texts.  The index keys a text by a hash of it: a collision adds a candidate,
which verification settles, and repeated rows share one entry.

Spans are in code points, end exclusive.  Each kind's spans are its leftmost
matches without overlap; those failing the kind's length drop afterwards.  Null
texts count as empty and have no spans; null or repeated doc_ids keep one row
for each row.  Very long texts are scanned whole, by expressions that walk once from
match to match.  An empty table gives an empty one.  Columns named as the helpers
here come back as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import aside, new_folder
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and Python alike. value, least: the group whose length in code points must be at least so much."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0

    @property
    def query(self) -> list[list[str]] | None:
        return trigram_query(self.pattern)


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that are long enough: runs are maximal, so none hides another
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("hugging_face", r"hf_[A-Za-z0-9]{30,}"),
    Rule("digital_ocean", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{32,}"),
    Rule("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("square", r"sq0(atp|csp)-[0-9A-Za-z_-]{22,}"),
    Rule("account_key", r"AccountKey=[A-Za-z0-9+/]{60,}={0,2}"),
    Rule("putty_key", r"PuTTY-User-Key-File-[0-9]"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("bearer", r"(?i)authorization:\x20*bearer\x20+[A-Za-z0-9._~+/=-]{16,}"),
)
RULES = (*BASE, *ADDED)


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    r"""array<struct<start, ord, kind, end>>: the rule's spans in a text.

    \G(.*?)(pattern) walks from match to match; the gaps' and matches' lengths add up to the places.
    """
    whole = F.lit(r"(?s)\G(.*?)(" + rule.pattern + ")")
    gaps, found = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    kept = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.value)) >= rule.least) if rule.least else (lambda m: F.lit(True))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), kept(m).alias("kept")))
    kind = "array<struct<start:int,ord:int,kind:string,end:int>>"

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["kept"], F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).cast(kind).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), step, lambda s: s["spans"])


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(texts: DataFrame, column: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, key): the inverted index, of the trigrams that these rules ask for."""
    asked = sorted({t for r in rules for c in r.query or [] for t in c})
    # lower() maps more than A-Z, which can only admit more candidates
    rows = texts.select(_key(F.col(column)).alias("key"), F.lower(column).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked)))
    rows = rows.select("key", has.alias("has"))
    # explode() would have Spark infer a filter and push it below, where the lower-cased text is made again for each trigram
    return rows.select("key", F.explode_outer("has").alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules array<int>): texts that meet some clause of a rule's query, by intersected postings."""
    spark = index.sparkSession
    clauses = [(k, n, t, len(c)) for k, r in enumerate(rules) for n, c in enumerate(r.query or []) for t in c]
    asked = spark.createDataFrame(clauses, "rule int, clause int, trigram string, needed int")  # as long as the list of rules
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "clause", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed")
    return met.groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # at most one entry for each rule


def scan(df: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, output: str = "spans") -> DataFrame:
    """df with output array<struct<start, ord, kind, end>>: all spans by start, then by the order of rules. A column of the output's name is replaced."""
    df = df.drop(*[c for c in df.columns if c.lower() == output.lower() and c != text_column])
    spark = df.sparkSession
    df, new, back = aside(df, ("_key", "_rules", "_text", output))
    text_column = new[text_column]
    folder = new_folder(spark, "secret-candidates")
    text = F.coalesce(F.col(text_column), F.lit(""))
    candidates(postings(df.select(text.alias("_text")), "_text", rules), rules).write.parquet(folder)
    # a table of known size: small ones are broadcast below the session's threshold, larger ones shuffled
    chosen = spark.read.parquet(folder).withColumnsRenamed({"key": "_key", "rules": "_rules"})
    rows = df.withColumn("_key", _key(text)).join(chosen, "_key", "left")
    spans = []
    for k, rule in enumerate(rules):
        asked = text.rlike(rule.pattern)
        if rule.query:
            asked = F.array_contains("_rules", k) & asked
        spans.append(F.when(asked, match_spans(text, rule, k)).otherwise(F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")))
    return back(rows.withColumn(output, F.array_sort(F.concat(*spans))).drop("_key", "_rules"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of documents."""
    rows = scan(df.select("doc_id", "text"), rules=rules, output="_spans")
    base = F.filter("_spans", lambda s: s["ord"] < len(BASE))
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))


def redact(df: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """df with every span in its texts replaced by a mark; overlapping spans fall under one mark. Texts without spans stay as they are."""
    columns = df.columns
    df, new, back = aside(df, ("_spans",))
    text_column = new[text_column]
    rows = scan(df, text_column, rules, "_spans")
    text = F.col(text_column)

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = F.concat(state["out"], gap, F.when(s["start"] >= state["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(new.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    rows = rows.withColumn(text_column, F.when(F.size("_spans") > 0, done).otherwise(text)).drop("_spans")
    return back(rows).select(*columns)
