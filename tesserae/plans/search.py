"""Keywords, search and classification over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, redaction, text
from ..operators import joins, keywords, search
from ._sql import IDF, is_term, words
from .tables import read

WEIGHTS = {"heading": 2.0, "body": 1.0}
PHRASES = [["token"], ["the", "ti"], ["mit", "license"], ["pathetic"]]
TERMS = ["token", "license", "mit", "pathetic", "en"]


def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return keywords.inverse_frequencies(keywords.document_terms(docs, "doc_id", "text"), docs).select("term", "df", F.round("idf", 6).alias("idf"))


IDF_TERMS = f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf"


def keyword_topk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    body = keywords.document_terms(docs, "doc_id", "text")
    idf = keywords.inverse_frequencies(body, docs)
    both = keywords.sourced_terms(docs.withColumn("head", F.substring_index("text", "\n", 1)), "doc_id", "text", "head")
    scored = keywords.keyword_scores(both, idf, WEIGHTS, "doc_id", once=True).withColumn("score", F.round("score", 6))
    return keywords.top_terms(scored, "doc_id", 8).select("doc_id", "rank", "term", "source", "score")


KEYWORD_TOPK = f"""
WITH {IDF},
heads AS (SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(list_distinct({words("split_part(text, chr(10), 1)")})) AS t FROM documents) WHERE {is_term('t')}),
best AS (SELECT doc_id, term, max(w) AS w, CASE WHEN max(w) = 2.0 THEN 'heading' ELSE 'body' END AS source
    FROM (SELECT doc_id, term, 1.0::DOUBLE AS w FROM terms UNION ALL SELECT doc_id, term, 2.0::DOUBLE FROM heads) GROUP BY doc_id, term),
scored AS (SELECT doc_id, term, source, round(w * idf, 6) AS score FROM best JOIN idf USING (term))
SELECT doc_id, rank, term, source, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INTEGER AS rank FROM scored) WHERE rank <= 8
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return search.bm25(docs, text.spaced_words("text"), PHRASES)


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.candidates(_scored(spark, sf_dir), ["doc_id"], 100)
    return top.select("doc_id", F.round("score", 6).alias("score"))


def _frequency(phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter(w, lambda t: starts_with(t, '{phrase[0]}')))"
    fits = " AND ".join([f"w[k + {n}] = '{p}'" for n, p in enumerate(phrase[:-1])] + [f"starts_with(w[k + {len(phrase) - 1}], '{phrase[-1]}')"])
    return f"len(list_filter(range(1, greatest(len(w) - {len(phrase) - 2}, 1)), lambda k: coalesce({fits}, false)))"


_TERM_SQL = " + ".join(
    f"(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END)::DOUBLE * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avg_d))" for k in range(len(PHRASES))
)
_BM25 = f"""
docs AS (SELECT doc_id, lang, source, text, {words('text')} AS w FROM documents),
counted AS (SELECT doc_id, lang, source, text, len(w) AS d, {", ".join(f"{_frequency(p)} AS f{k}" for k, p in enumerate(PHRASES))} FROM docs),
stats AS (SELECT count(*) AS n, avg(d) AS avg_d, {", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(PHRASES)))} FROM counted),
scored AS (SELECT doc_id, lang, source, text, ({_TERM_SQL})::DOUBLE AS score FROM counted, stats WHERE {" OR ".join(f"f{k} > 0" for k in range(len(PHRASES)))})
"""
BM25_SEARCH = f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 100"


def search_rerank_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25, structural re-ranking by heading, place and the document's 15 most frequent terms, three hits a source first."""
    hits = search.candidates(_scored(spark, sf_dir), ["doc_id"]).withColumn("head", F.substring_index("text", "\n", 1))
    own = ["doc_id", "source", "lang", "head", "score"]
    terms = hits.select(*own, F.explode_outer(F.filter(text.ascii_words("text"), lambda t: text.is_term(t))).alias("term"))
    ranked = keywords.top_terms(terms.groupBy(*own, "term").agg(F.count("term").alias("n")).withColumnRenamed("score", "bm25").withColumnRenamed("n", "score"), "doc_id", 15)
    hits = ranked.withColumnRenamed("bm25", "_b").groupBy("doc_id", "source", "lang", "head", "_b").agg(F.collect_set("term").alias("kept")).withColumnRenamed("_b", "score")
    kind = F.when(F.col("source").endswith("7"), "test_unit").when(F.col("source").endswith("9"), "documentation").otherwise("source")
    ranked = search.rerank(hits, TERMS, F.slice(text.ascii_words("head"), 1, 12), F.concat_ws("/", "source", "head"), F.array(F.lower("source"), F.lower("lang")), F.col("kept"), kind)
    return search.diversify(ranked, "source", ["doc_id"], 20).select("doc_id", "source", "total", "in_path")


_T = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_SHARE = "CASE WHEN len(list_distinct({p})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({p}), " + _T + "))::DOUBLE / len(list_distinct({p})) END"
RERANK = f"""
WITH {_BM25},
hits AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 400),
counted_terms AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({words("text")}) AS t FROM hits) WHERE {is_term('t')} GROUP BY doc_id, t),
kept AS (SELECT doc_id, list(t) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) AS r FROM counted_terms) WHERE r <= 15 GROUP BY doc_id),
parts AS (SELECT *, list_slice({words("split_part(text, chr(10), 1)")}, 1, 12) AS h, [lower(source), lower(lang)] AS pp, source || '/' || split_part(text, chr(10), 1) AS q,
    coalesce(kw, []) AS kw, CASE WHEN source LIKE '%7' THEN 0.8 WHEN source LIKE '%9' THEN 0.7 ELSE 1.0 END::DOUBLE AS factor FROM hits LEFT JOIN kept USING (doc_id)),
ranked AS (SELECT doc_id, source, round((score
    + CASE WHEN list_contains({_T}, array_to_string(h, '_')) OR list_contains({_T}, array_to_string(h, '')) THEN 4.0 ELSE 4.0 * ({_SHARE.format(p='h')}) END
    + CASE WHEN len(list_filter({_T}, lambda t: contains(lower(q), t))) > 0 THEN 1.5 ELSE 0.0 END
    + 1.2::DOUBLE * ({_SHARE.format(p='pp')}) + len(list_intersect(kw, {_T}))) * factor, 6) AS total FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, doc_id)::INTEGER AS in_path FROM ranked)
SELECT doc_id, source, total, in_path FROM placed ORDER BY in_path > 3, total DESC, doc_id LIMIT 20
"""


def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    name = F.concat_ws("_", F.regexp_replace("p_name", " ", ""), F.concat(F.lit("HTTPServer"), F.col("p_brand")), F.lit("parseXMLNode2"))
    return parts.select("p_partkey", F.array_join(F.transform(text.split_identifier(name), F.lower), " ").alias("parts"))


_BOUNDS = "regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g')"
IDENTIFIER_SPLIT = f"""
SELECT p_partkey, lower(array_to_string(list_filter(regexp_split_to_array({_BOUNDS.format(x="concat_ws('_', replace(p_name, ' ', ''), 'HTTPServer' || p_brand, 'parseXMLNode2')")}, '[^A-Za-z0-9]+'), lambda x: x <> ''), ' ')) AS parts FROM part
"""


def structure_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(text.structure_hash(F.col("text")).alias("structure_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


STRUCTURE_DUPES = r"""
WITH h AS (SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(30))) AS structure_hash FROM documents)
SELECT structure_hash, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM h GROUP BY structure_hash HAVING count(*) > 1
"""

RULES = [("**/*.html", "template"), ("en/**", "source"), ("fr/*", "test"), ("de/[0-9]*", "documentation"), ("**/??", "config")]


def classify_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = text.normalize_path(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "[?#].*$", ""))
    return pages.select("page_id", globs.classify(path, RULES, "other").alias("file_class"))


CLASSIFY = """
WITH p AS (SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', ''), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '%.html' THEN 'template' WHEN regexp_matches(path, '^en(/.*)?$') THEN 'source' WHEN regexp_matches(path, '^fr/[^/]*$') THEN 'test'
    WHEN regexp_matches(path, '^de/[0-9][^/]*$') THEN 'documentation' WHEN regexp_matches(path, '^([^/]+/)*[^/][^/]$') THEN 'config' ELSE 'other' END AS file_class FROM p
"""

_CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"


def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tokens and their entropy; a threshold under 4 also flags hex digits."""
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(_CANDIDATE))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_CANDIDATE})"), F.lit(1)))).alias("token"))
    told = tokens.withColumn("entropy", F.round(redaction.entropy(F.col("token")), 6))
    return told.where("entropy > 3.5").select("doc_id", "token", "entropy")


ENTROPY_TOKENS = f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '({_CANDIDATE})', 1))) AS token FROM documents),
c AS (SELECT doc_id, token, u AS letter, count(*)::DOUBLE / length(token) AS p FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS u FROM t) WHERE u <> '' GROUP BY doc_id, token, u)
SELECT doc_id, token, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY doc_id, token HAVING round(-sum(p * log2(p)), 6) > 3.5
"""


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed secrets, marks and key names in texts, by source."""
    docs = read(spark, sf_dir, "documents")
    keyed = F.regexp_count("text", F.lit("(?i)(password|token|secret)[ ]*[:=][ ]*[\"']?[A-Za-z0-9]{8,}"))
    return docs.groupBy("source").agg(F.sum(keyed).cast("long").alias("keyed"), F.count_if(redaction.is_secret_key(F.col("text"))).alias("with_key_name"), F.sum(F.regexp_count("text", F.lit("[0-9a-f]{40}"))).cast("long").alias("digests"))


REDACT_COUNTS = """
SELECT source, sum(len(regexp_extract_all(text, '(?i)(password|token|secret)[ ]*[:=][ ]*["'']?[A-Za-z0-9]{8,}')))::BIGINT AS keyed,
    count(*) FILTER (regexp_matches(lower(text), 'password|passwd|secret|token|api_key|apikey|credential|private_key'))::BIGINT AS with_key_name,
    sum(len(regexp_extract_all(text, '[0-9a-f]{40}')))::BIGINT AS digests
FROM documents GROUP BY source
"""


def raw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return search.raw_scores(docs, "text", ["token", "license", "mit"], "mit license").orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", "score")


_RAW = ["token", "license", "mit"]
RAW_SEARCH = f"""
WITH s AS (SELECT doc_id, {" + ".join(f"contains(lower(text), '{t}')::INTEGER" for t in _RAW)} AS found,
    {" + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}.0::DOUBLE" for t in _RAW)} AS places, contains(lower(text), 'mit license') AS phrase FROM documents)
SELECT doc_id, round(0.7::DOUBLE * found / 3 + 0.2::DOUBLE * least(1.0, places / 12) + CASE WHEN phrase THEN 0.1 ELSE 0.0 END::DOUBLE, 6) AS score
FROM s WHERE found > 0 ORDER BY score DESC, doc_id LIMIT 50
"""


def numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lines(read(spark, sf_dir, "documents"))
    weight = F.when(F.col("source").endswith("1"), 0.5).otherwise(1.0)
    scored = search.regex_scores(lines, "doc_id", "line", "line_text", ["token", "license", "public", "mit"], weight, F.col("line_text").rlike("^[A-Z]"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(50)


_LINES = "lines AS (SELECT doc_id, source, line::INTEGER AS line, line_text FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))"
REGEX_SEARCH = f"""
WITH {_LINES},
hits AS (SELECT *, list_filter(['token', 'license', 'public', 'mit'], lambda t: contains(lower(line_text), t)) AS t FROM lines),
hitlines AS (SELECT * FROM hits WHERE len(t) > 0),
near AS (SELECT a.doc_id, a.line, count(DISTINCT u.t) AS near FROM hitlines a JOIN (SELECT doc_id, line, unnest(t) AS t FROM hitlines) u ON a.doc_id = u.doc_id AND u.line BETWEEN a.line - 4 AND a.line + 4 GROUP BY a.doc_id, a.line),
cover AS (SELECT doc_id, count(DISTINCT t) AS cover FROM (SELECT doc_id, unnest(t) AS t FROM hitlines) GROUP BY doc_id),
by_doc AS (SELECT s.doc_id, max(n.near) AS near, count(*) AS rows, max(CASE WHEN source LIKE '%1' THEN 0.5 ELSE 1.0 END)::DOUBLE AS class, max(regexp_matches(line_text, '^[A-Z]')::INTEGER) AS defined FROM hitlines s JOIN near n USING (doc_id, line) GROUP BY s.doc_id)
SELECT doc_id, cover::INTEGER AS cover, near::INTEGER AS near, rows::BIGINT AS rows, round(0.55::DOUBLE * cover / 4 + 0.20::DOUBLE * near / 4 + 0.10::DOUBLE * least(1.0, rows / 20.0::DOUBLE) + 0.10::DOUBLE * class + 0.05::DOUBLE * defined, 6) AS score
FROM by_doc JOIN cover USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50
"""


def docs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lines(read(spark, sf_dir, "documents"))
    return search.docs_scores(lines, "doc_id", "line_text", ["token", "license"]).orderBy(F.desc("score"), "doc_id").limit(50)


DOCS_SEARCH = f"""
WITH {_LINES},
hitlines AS (SELECT doc_id, line, list_filter(['token', 'license'], lambda t: contains(lower(line_text), t)) AS t FROM lines),
c AS (SELECT doc_id, count(DISTINCT t) AS cover FROM (SELECT doc_id, unnest(t) AS t FROM hitlines) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS rows FROM hitlines WHERE len(t) > 0 GROUP BY doc_id)
SELECT doc_id, cover::INTEGER AS cover, rows::BIGINT AS rows, round(0.7::DOUBLE * cover / 2 + 0.3::DOUBLE * least(1.0, rows / 8.0::DOUBLE), 6) AS score FROM c JOIN r USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50
"""


def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tags: the type's words are the name, the brand the signature."""
    parts = read(spark, sf_dir, "part")
    words_of = text.ascii_words("p_type")
    scored = search.tag_scores(parts, words_of, F.col("p_brand"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.5), F.array_contains(words_of, "large"), ["large", "pro", "brand"])
    return scored.orderBy(F.desc("score"), "p_partkey").limit(50).select("p_partkey", "score")


_TAG_HIT = "CASE WHEN list_contains(w, '{t}') THEN 1.0 WHEN len(list_filter(w, lambda p: starts_with(p, '{t}'))) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE"
TAG_SEARCH = f"""
WITH t AS (SELECT p_partkey, p_size, p_brand, {words('p_type')} AS w FROM part),
c AS (SELECT *, ({" + ".join(_TAG_HIT.format(t=t) for t in ("large", "pro", "brand"))}) / 3 AS cover, {" + ".join(f"contains(lower(p_brand), '{t}')::INTEGER" for t in ("large", "pro", "brand"))} AS signed FROM t)
SELECT p_partkey, round(0.55::DOUBLE * cover + 0.15::DOUBLE * (signed / 3) + 0.20::DOUBLE * CASE WHEN p_size > 25 THEN 1.0 ELSE 0.5 END::DOUBLE + CASE WHEN list_contains(w, 'large') THEN 0.30 ELSE 0.0 END::DOUBLE, 6) AS score
FROM c WHERE cover > 0 ORDER BY score DESC, p_partkey LIMIT 50
"""


def syntax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    words_of = text.ascii_words("p_name")
    scored = search.syntax_scores(parts, F.concat(words_of, text.ascii_words("p_type")), F.col("p_brand"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.4), F.array_contains(words_of, "plate"), F.col("p_partkey") % 3 == 0, ["plate", "large", "brand"])
    return scored.orderBy(F.desc("score"), "p_partkey").limit(50).select("p_partkey", "score")


SYNTAX_SEARCH = f"""
WITH t AS (SELECT *, {words('p_name')} AS n, list_concat({words('p_name')}, {words('p_type')}) AS w FROM part),
c AS (SELECT *, len(list_intersect(list_distinct(w), ['plate', 'large', 'brand'])) / 3 AS cover, contains(lower(p_brand), 'plate')::INTEGER + contains(lower(p_brand), 'large')::INTEGER + contains(lower(p_brand), 'brand')::INTEGER AS signed FROM t)
SELECT p_partkey, round((0.50::DOUBLE * cover + 0.15::DOUBLE * (signed / 3) + 0.15::DOUBLE * CASE WHEN p_size > 25 THEN 1.0 ELSE 0.4 END::DOUBLE + CASE WHEN list_contains(n, 'plate') THEN 0.30 ELSE 0.0 END::DOUBLE) * CASE WHEN p_partkey % 3 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE, 6) AS score
FROM c WHERE cover > 0 ORDER BY score DESC, p_partkey LIMIT 50
"""


def proximity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lines(read(spark, sf_dir, "documents"))
    hits = lines.select("doc_id", "line", F.explode(F.filter(F.array(F.lit("token"), F.lit("license"), F.lit("the "), F.lit("pathetic")), lambda t: F.contains(F.lower("line_text"), t))).alias("term"))
    return joins.terms_nearby(hits, "doc_id", "line", "term", 4).groupBy("doc_id").agg(F.max("n_terms").alias("most_terms"), F.count(F.lit(1)).alias("hits"))


PROXIMITY = f"""
WITH {_LINES},
hits AS (SELECT doc_id, line, unnest(list_filter(['token', 'license', 'the ', 'pathetic'], lambda t: contains(lower(line_text), t))) AS term FROM lines),
near AS (SELECT a.doc_id, a.line, count(DISTINCT b.term) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.line BETWEEN a.line - 4 AND a.line + 4 GROUP BY a.doc_id, a.line),
c AS (SELECT doc_id, count(*)::BIGINT AS hits FROM hits GROUP BY doc_id)
SELECT doc_id, max(n)::INTEGER AS most_terms, any_value(hits) AS hits FROM near JOIN c USING (doc_id) GROUP BY doc_id
"""


def regions_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lines(read(spark, sf_dir, "documents")).where(F.lower("line_text").contains("the "))
    return joins.islands(lines, "doc_id", "line", 3).where("region <= 3")


REGIONS = f"""
WITH {_LINES},
hits AS (SELECT doc_id, line FROM lines WHERE contains(lower(line_text), 'the ')),
marked AS (SELECT *, CASE WHEN line - 3 > lag(line) OVER (PARTITION BY doc_id ORDER BY line) + 4 OR lag(line) OVER (PARTITION BY doc_id ORDER BY line) IS NULL THEN 1 ELSE 0 END AS new FROM hits),
told AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS region FROM marked)
SELECT doc_id, region::INTEGER AS region, greatest(min(line) - 3, 1)::INTEGER AS first, (max(line) + 3)::INTEGER AS last, count(*)::BIGINT AS hits FROM told WHERE region <= 3 GROUP BY doc_id, region
"""

QUERIES = {
    "search_rerank_diversify": (search_rerank_diversify, RERANK), "bm25_search": (bm25_search, BM25_SEARCH), "idf_terms": (idf_terms, IDF_TERMS), "keyword_topk_per_doc": (keyword_topk_per_doc, KEYWORD_TOPK),
    "identifier_split": (identifier_split, IDENTIFIER_SPLIT), "structure_hash_dupes": (structure_hash_dupes, STRUCTURE_DUPES), "classify_by_rules": (classify_by_rules, CLASSIFY),
    "entropy_tokens": (entropy_tokens, ENTROPY_TOKENS), "redact_counts": (redact_counts, REDACT_COUNTS), "raw_search": (raw_search, RAW_SEARCH), "regex_search": (regex_search, REGEX_SEARCH),
    "docs_search": (docs_search, DOCS_SEARCH), "tag_search": (tag_search, TAG_SEARCH), "syntax_search": (syntax_search, SYNTAX_SEARCH), "proximity_terms": (proximity_terms, PROXIMITY), "regions_islands": (regions_islands, REGIONS),
}
