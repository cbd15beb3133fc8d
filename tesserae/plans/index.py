"""Queries over the index of the source tree in plans.tree: what extraction, resolution and lookups find, beside what the tables say."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract as extraction
from .. import indexer
from ..api import Engine
from ..config import Config
from ..functions import globs, text
from ..operators import joins, resolve, search
from ..sources import files as sources
from . import tree
from .tables import read, scratch
from .tree import FILES, rows_sql, sql_text, union_sql


#: What resolution needs of symbols and references; imports go whole.
_RESOLVED = {"symbols": ["stable_key", "kind", "name", "qualified_name", "line_start"], "refs": ["source_key", "kind", "name", "line", "receiver"], "imports": None}


def _parsed(spark: SparkSession, sf_dir: str, lists: dict[str, list[str] | None]) -> tuple[DataFrame, DataFrame]:
    """(files without their texts, extracted): the lists of one parse, written to the shared folder for the several tables that follow from them."""
    files = tree.described(spark, sf_dir)
    return files.drop("content_text"), indexer.stored(extraction.extract(files, lists), scratch(spark))


def _rows(spark: SparkSession, sf_dir: str, name: str, fields: list[str]) -> DataFrame:
    return extraction.extract_rows(tree.described(spark, sf_dir), name, fields)


# files: discovery, classes, languages, lines

_KIND_OF = {"module": ("python", "source", 23), "test": ("python", "test_unit", 5), "page": ("markdown", "documentation", 11), "settings": ("toml", "config", 8), "go": ("go", "source", 13), "generated": ("python", "generated", 1)}


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.described(spark, sf_dir).drop("content_text")


TREE_FILES = union_sql([
    (kind, {"path": FILES[kind][2], "language": language, "file_class": file_class, "byte_size": f"=octet_length(encode({sql_text(FILES[kind][3], kind)}))::BIGINT", "line_count": f"={lines}::INTEGER",
            "source_hash": f"=sha256({sql_text(FILES[kind][3], kind)} || octet_length(encode({sql_text(FILES[kind][3], kind)}))::VARCHAR)", "parse_state": "pending"})
    for kind, (language, file_class, lines) in _KIND_OF.items()
])


def tree_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of an ignore file: a name anywhere, an anchored folder, a class of characters, an exception that comes later."""
    rules = globs.ignore_rules(["# comment", "*.toml", "!customer_1?.toml", "/docs/", "part_[0-4].py", "lib/**/nation_?.go"])
    return tree.files(spark, sf_dir).select("path", globs.is_ignored(F.col("path"), rules).alias("ignored"))


TREE_IGNORED = "WITH f AS (" + union_sql([(kind, {"path": FILES[kind][2]}) for kind in FILES]) + r""")
SELECT path, (path LIKE '%.toml' AND NOT regexp_matches(path, '/customer_1.\.toml$')) OR path LIKE 'docs/%' OR regexp_matches(path, '(^|/)part_[0-4]\.py$') OR regexp_matches(path, '^lib/nation_.\.go$') AS ignored FROM f
"""


def tree_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines that match any of the patterns, with what matched."""
    found = sources.search_lines(sources.lines(tree.described(spark, sf_dir)), [r"make_\d+", r"brand#1\b", "getenv"], ignore_case=True)
    return found.select("path", "line", "line_text", F.array_join("matches", "|").alias("matches"))


TREE_GREP = "WITH f AS (" + union_sql([(kind, {"path": FILES[kind][2], "content": FILES[kind][3]}) for kind in FILES]) + r"""),
n AS (SELECT path, unnest(string_split(regexp_replace(content, '\n$', ''), chr(10))) AS line_text, generate_subscripts(string_split(regexp_replace(content, '\n$', ''), chr(10)), 1)::INTEGER AS line FROM f)
SELECT path, line, line_text, array_to_string(regexp_extract_all(line_text, '(?i)make_\d+|brand#1\b|getenv'), '|') AS matches FROM n WHERE regexp_matches(line_text, '(?i)make_\d+|brand#1\b|getenv')
"""

# extraction

_M, _T, _P, _S, _G = "python:src/stock/part_{k}.py:", "python:tests/test_part_{k}.py:", "markdown:docs/supplier_{k}.md:", "config:conf/customer_{k}.toml:", "go:lib/nation_{k}.go:"
MODULE_KEY, CLASS_KEY, METHOD_KEY, FUNCTION_KEY = _M + "module:src.stock.part_{k}()", _M + "class:Part{k}()", _M + "method:Part{k}.make_{k}(size)", _M + "function:check_{k}(value,depth)"
CONSTANT_KEY, TEST_MODULE, TEST_KEY = _M + "constant:LIMIT_{k}()", _T + "module:tests.test_part_{k}()", _T + "test:test_check_{k}(bench)"
PAGE_KEY, TOP_KEY, TERMS_KEY, SETTINGS_KEY, GO_KEY = _P + "document:docs/supplier_{k}.md()", _P + "section:Supplier {k}()", _P + "section:Supplier {k} > Terms()", _S + "config:conf/customer_{k}.toml()", _G + "module:lib/nation_{k}.go()"
GENERATED_KEY = "python:gen/region_{k}_pb2.py:module:gen/region_{k}_pb2.py()"
#: kind of file, key, parent, kind, name, qualified name, first line, last line, signature, return type
SYMBOLS = [
    ("module", MODULE_KEY, "", "module", "part_{k}", "src.stock.part_{k}", 1, 24, "", ""), ("module", CONSTANT_KEY, MODULE_KEY, "constant", "LIMIT_{k}", "LIMIT_{k}", 8, 8, "", ""),
    ("module", CLASS_KEY, MODULE_KEY, "class", "Part{k}", "Part{k}", 11, 18, "class Part{k}(Base{size})", ""), ("module", METHOD_KEY, CLASS_KEY, "method", "make_{k}", "Part{k}.make_{k}", 14, 18, "def make_{k}(self, size: int) -> str", "str"),
    ("module", FUNCTION_KEY, MODULE_KEY, "function", "check_{k}", "check_{k}", 21, 23, "def check_{k}(value, depth=1)", ""),
    ("test", TEST_MODULE, "", "module", "test_part_{k}", "tests.test_part_{k}", 1, 6, "", ""), ("test", TEST_KEY, TEST_MODULE, "test", "test_check_{k}", "test_check_{k}", 4, 5, "def test_check_{k}(bench)", ""),
    ("page", PAGE_KEY, "", "document", "supplier_{k}.md", "docs/supplier_{k}.md", 1, 11, "", ""), ("page", TOP_KEY, PAGE_KEY, "section", "Supplier {k}", "Supplier {k}", 1, 8, "# Supplier {k}", ""), ("page", TERMS_KEY, TOP_KEY, "section", "Terms", "Supplier {k} > Terms", 5, 8, "## Terms", ""),
    ("settings", SETTINGS_KEY, "", "config", "customer_{k}.toml", "conf/customer_{k}.toml", 1, 9, "", ""),
    ("go", GO_KEY, "", "module", "nation_{k}.go", "lib/nation_{k}.go", 1, 13, "", ""), ("go", _G + "struct:Nation{k}()", GO_KEY, "struct", "Nation{k}", "Nation{k}", 3, 5, "type Nation{k} struct", ""),
    ("go", _G + "method:Region()", GO_KEY, "method", "Region", "Region", 7, 9, "func (n *Nation{k}) Region() int", ""), ("go", _G + "function:New{k}()", GO_KEY, "function", "New{k}", "New{k}", 11, 13, "func New{k}() *Nation{k}", ""),
    ("generated", GENERATED_KEY, "", "module", "region_{k}_pb2.py", "gen/region_{k}_pb2.py", 1, 1, "", ""),
]
SYMBOLS_SQL = union_sql([
    (f, {"path": FILES[f][2], "stable_key": key, "parent_key": parent or "=NULL::VARCHAR", "kind": kind, "name": name, "qualified_name": qualified, "line_start": f"={first}::INTEGER", "line_end": f"={last}::INTEGER", "signature": signature, "return_type": returns, "visibility": "public"})
    for f, key, parent, kind, name, qualified, first, last, signature, returns in SYMBOLS
])


def index_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "symbols", ["stable_key", "parent_key", "kind", "name", "qualified_name", "line_start", "line_end", "signature", "return_type", "visibility"])


#: kind of file, symbol, kind, value, line, priority, confidence
FACTS = [
    ("module", MODULE_KEY, "purpose", "Keeps the {name} of {brand}.", 1, 1, 0.9), ("module", MODULE_KEY, "raises", "ValueError", 1, 2, 0.6), ("module", CONSTANT_KEY, "default", "LIMIT_{k}={size}", 8, 4, 0.9), ("module", CLASS_KEY, "purpose", "A {name}.", 11, 1, 0.9),
    ("module", METHOD_KEY, "call", "ValueError", 17, 4, 0.9), ("module", METHOD_KEY, "call", "make_{before}", 18, 4, 0.9), ("module", METHOD_KEY, "raises", "ValueError", 17, 2, 0.9), ("module", METHOD_KEY, "literal", "too large", 17, 5, 0.9), ("module", METHOD_KEY, "returns", "make_{before}", 18, 2, 0.9),
    ("module", METHOD_KEY, "invariant", "the size must never pass the limit", 15, 1, 0.7), ("module", FUNCTION_KEY, "call", "json.dumps", 23, 4, 0.9), ("module", FUNCTION_KEY, "assertion", "value", 22, 3, 0.9), ("module", FUNCTION_KEY, "member", "json.dumps", 23, 5, 0.9), ("module", FUNCTION_KEY, "side_effect", "serialization", 23, 2, 0.9), ("module", FUNCTION_KEY, "returns", "json.dumps", 23, 2, 0.9),
    ("test", TEST_KEY, "call", "check_{k}", 5, 4, 0.9), ("test", TEST_KEY, "assertion", "check_{k}('{brand}')", 5, 3, 0.9), ("test", TEST_KEY, "literal", "{brand}", 5, 5, 0.9),
    ("page", TOP_KEY, "excerpt", "{name} delivers to nation {nation}, see [its part](src/stock/part_{k}.py).", 3, 3, 0.8), ("page", TOP_KEY, "link", "src/stock/part_{k}.py", 3, 5, 0.9), ("page", TERMS_KEY, "excerpt", "Orders must be paid in full, and `check_{k}()` says so.", 7, 3, 0.8),
    ("page", TERMS_KEY, "invariant", "Orders must be paid in full, and `check_{k}()` says so.", 7, 2, 0.7), ("page", TERMS_KEY, "mention", "check_{k}()", 7, 5, 0.7), ("page", TERMS_KEY, "command", "deliver --supplier {k}", 10, 3, 0.8),
    *(("settings", SETTINGS_KEY, "config", x, 1, 3, 1.0) for x in ("customer.key={k}", "customer.segment={segment}", "customer.tags=a, b{nation}", "customer.limits.nation={nation}", "customer.limits.open=true")),
    ("go", GO_KEY, "env", "NATION_{k}", 1, 3, 0.8), ("generated", GENERATED_KEY, "metadata", "metadata", 1, 6, 1.0),
]
FACTS_SQL = union_sql([
    (f, {"path": FILES[f][2], "symbol_key": key, "kind": kind, "value": value, "line": f"={line}::INTEGER", "priority": f"={priority}::INTEGER", "confidence": f"={sure}::DOUBLE"}) for f, key, kind, value, line, priority, sure in FACTS
])


def index_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "facts", ["symbol_key", "kind", "value", "line", "priority", "confidence"])


#: kind of file, symbol, kind, name, line, receiver, arguments
REFS = [
    ("module", MODULE_KEY, "IMPORTS", "json", 5, "", -1), ("module", MODULE_KEY, "IMPORTS", "stock.part_{before}", 6, "", -1), ("module", CLASS_KEY, "EXTENDS", "Base{size}", 11, "", -1), ("module", METHOD_KEY, "USES_TYPE", "int", 14, "", -1), ("module", METHOD_KEY, "REFERENCES", "ValueError", 17, "", -1),
    ("module", METHOD_KEY, "CALLS", "ValueError", 17, "", 1), ("module", METHOD_KEY, "CALLS", "make_{before}", 18, "", 1), ("module", FUNCTION_KEY, "CALLS", "dumps", 23, "json", 1),
    ("test", TEST_MODULE, "IMPORTS", "stock.part_{k}", 1, "", -1), ("test", TEST_KEY, "USES_FIXTURE", "bench", 4, "", -1), ("test", TEST_KEY, "TESTS", "check_{k}", 5, "", 1), ("page", TOP_KEY, "DOCUMENTS", "src/stock/part_{k}.py", 3, "", -1), ("page", TERMS_KEY, "DOCUMENTS", "check_{k}", 7, "", -1),
]
REFS_SQL = union_sql([(f, {"path": FILES[f][2], "source_key": key, "kind": kind, "name": name, "line": f"={line}::INTEGER", "receiver": receiver, "arity": f"={n}::INTEGER"}) for f, key, kind, name, line, receiver, n in REFS])


def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "refs", ["source_key", "kind", "name", "line", "receiver", "arity"])


def index_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with the file that each stands for: a module path under any root of the tree, or none."""
    files, extracted = _parsed(spark, sf_dir, {"imports": None})
    imports = extraction.exploded(extracted, "imports")
    return indexer.import_targets(imports, files).select("path", "resolved_module", "line", "target_path")


IMPORTS_SQL = f"""
SELECT i.path, resolved_module, line, f.path AS target_path
FROM ({union_sql([("module", {"path": FILES["module"][2], "resolved_module": "json", "line": "=5::INTEGER"}), ("module", {"path": FILES["module"][2], "resolved_module": "stock.part_{before}", "line": "=6::INTEGER"}), ("test", {"path": FILES["test"][2], "resolved_module": "stock.part_{k}", "line": "=1::INTEGER"})])}) i
LEFT JOIN ({rows_sql("module", {"path": FILES["module"][2], "module": "stock.part_{k}"})}) f ON resolved_module = module
"""

EDGE = ["source", "kind", "target", "external", "tier", "confidence", "path", "line"]


def index_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference by the tiers: same file, imported, unique, ambiguous, outside."""
    return _edges(*_parsed(spark, sf_dir, _RESOLVED))


def _edges(files: DataFrame, extracted: DataFrame) -> DataFrame:
    symbols, refs, imports = (extraction.exploded(extracted, c) for c in ("symbols", "refs", "imports"))
    return indexer.relationships(refs, symbols, indexer.import_targets(imports, files), files, Config()).select(*EDGE)


def _edge(f: str, source: str, kind: str, line: int, external: str, target: str = "", tier: str = "R4", confidence: float = 0.3) -> str:
    return rows_sql(f, {"source": source, "kind": kind, "line": f"={line}::INTEGER", "external": external or "=NULL::VARCHAR", "target": target or "=NULL::VARCHAR", "tier": tier, "confidence": f"={confidence}::DOUBLE", "path": FILES[f][2]})


_BEFORE = lambda key: key.replace("{k}", "{before}")
#: What a part's neighbour gives, if the tables have it, else the name as an outsider.
_MAYBE = [("module", MODULE_KEY, "IMPORTS", 6, "stock.part_{before}", _BEFORE(MODULE_KEY), "R1", 0.9, "p_partkey - 1"), ("module", METHOD_KEY, "CALLS", 18, "make_{before}", _BEFORE(METHOD_KEY), "R1", 0.9, "p_partkey - 1"), ("page", TOP_KEY, "DOCUMENTS", 3, "src/stock/part_{k}.py", MODULE_KEY, "R1", 0.9, "s_suppkey - 1"), ("page", TERMS_KEY, "DOCUMENTS", 7, "check_{k}", FUNCTION_KEY, "R2", 0.7, "s_suppkey - 1")]
_OUTSIDE = [("module", MODULE_KEY, "IMPORTS", 5, "json"), ("module", CLASS_KEY, "EXTENDS", 11, "Base{size}"), ("module", METHOD_KEY, "USES_TYPE", 14, "int"), ("module", METHOD_KEY, "REFERENCES", 17, "ValueError"), ("module", METHOD_KEY, "CALLS", 17, "ValueError"), ("module", FUNCTION_KEY, "CALLS", 23, "json.dumps"), ("test", TEST_KEY, "USES_FIXTURE", 4, "bench")]
RELATIONSHIPS_SQL = " UNION ALL ".join([
    *(_edge(*x) for x in _OUTSIDE), _edge("test", TEST_MODULE, "IMPORTS", 1, "", MODULE_KEY, "R1", 0.9), _edge("test", TEST_KEY, "TESTS", 5, "", FUNCTION_KEY, "R1", 0.9),
    *(_edge(f, s, k, n, "", t, tier, c) + f" AND {of} IN (SELECT p_partkey FROM part)" for f, s, k, n, _, t, tier, c, of in _MAYBE), *(_edge(f, s, k, n, e) + f" AND {of} NOT IN (SELECT p_partkey FROM part)" for f, s, k, n, e, _, _, _, of in _MAYBE),
])
_RELATIONSHIPS = f"WITH edges AS ({RELATIONSHIPS_SQL}), symbols AS ({SYMBOLS_SQL})"


def index_tier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.tier_rates(index_relationships(spark, sf_dir))


def index_tests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tests and pages name each symbol: edges joined to both ends' symbols, targets that are outside kept as they are."""
    files, extracted = _parsed(spark, sf_dir, _RESOLVED)
    symbols = extraction.exploded(extracted, "symbols").select("stable_key", "qualified_name")
    edges = _edges(files, extracted).where(F.col("kind").isin("TESTS", "DOCUMENTS", "EXTENDS"))
    named = joins.join_present(edges.join(symbols.withColumnsRenamed({"stable_key": "source", "qualified_name": "by"}), "source"), symbols.withColumnsRenamed({"stable_key": "target", "qualified_name": "of"}), "target")
    return named.select("by", "kind", F.coalesce("of", "external").alias("of"), "path", "line")


TESTS_OF = f"{_RELATIONSHIPS} SELECT s.qualified_name AS by, e.kind, coalesce(t.qualified_name, external) AS of, e.path, line FROM edges e JOIN symbols s ON s.stable_key = source LEFT JOIN symbols t ON t.stable_key = target WHERE e.kind IN ('TESTS', 'DOCUMENTS', 'EXTENDS')"


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by bare or qualified name in any case."""
    asked = F.explode(F.array(*map(F.lit, ["part7", "PART9.MAKE_9", "make_12", "Terms", "region", "nobody"])))
    files = tree.described(spark, sf_dir).where(F.col("path").rlike("^(src|docs|lib)/"))
    symbols = extraction.extract_rows(files, "symbols", ["stable_key", "kind", "name", "qualified_name"])
    return symbols.withColumn("asked", asked).where(text.names_match(F.col("asked"), F.col("name"), F.col("qualified_name"))).select("asked", "stable_key", "kind")


LOOKUP = f"WITH symbols AS ({SYMBOLS_SQL}) SELECT asked, stable_key, kind FROM symbols, (SELECT unnest(['part7', 'PART9.MAKE_9', 'make_12', 'Terms', 'region', 'nobody']) AS asked) WHERE regexp_matches(path, '^(src|docs|lib)/') AND (lower(name) = lower(asked) OR lower(qualified_name) = lower(asked) OR ends_with(lower(qualified_name), '.' || lower(asked)))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, extracted = _parsed(spark, sf_dir, {"symbols": ["stable_key", "kind", "name", "qualified_name", "signature"], "facts": ["symbol_key", "value", "priority"], "keywords": None})
    symbols, facts, candidates = (extraction.exploded(extracted, c) for c in ("symbols", "facts", "keywords"))
    chosen = candidates.where("source = 'name'").unionByName(candidates.where("source = 'path'").withColumn("symbol_key", F.lit(None).cast("string")))
    return indexer.search_documents(files, symbols, facts, chosen)


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search document for each file and symbol, with names and steps of paths as keywords."""
    return _documents(spark, sf_dir)


_NAME_WORDS = {CONSTANT_KEY: "limit limit_{k}", CLASS_KEY: "part{k}", METHOD_KEY: "make make_{k}", FUNCTION_KEY: "check check_{k}", TEST_KEY: "check test test_check_{k}", _G + "struct:Nation{k}()": "nation{k}", _G + "method:Region()": "region", _G + "function:New{k}()": "new{k}"}
_PATH_WORDS = {"module": "part src stock", "test": "part test tests", "page": "docs supplier", "settings": "conf customer toml", "go": "lib nation", "generated": "gen pb2 region"}
_DOCUMENTS = f"""
facts AS ({FACTS_SQL}), said AS (SELECT symbol_key, array_to_string(list_sort(list(DISTINCT value)), ' ') AS facts FROM facts WHERE priority <= 3 GROUP BY symbol_key),
given AS ({union_sql([(f, {"doc_kind": "symbol", "doc_id": key, "path": FILES[f][2], "symbol": name, "qualified": qualified, "signature": signature, "keywords": _NAME_WORDS.get(key, ""), "role": kind, "klass": _KIND_OF[f][1]}) for f, key, _, kind, name, qualified, _, _, signature, _ in SYMBOLS])}
    UNION ALL {union_sql([(f, {"doc_kind": "file", "doc_id": FILES[f][2], "path": FILES[f][2], "symbol": "", "qualified": "", "signature": "", "keywords": _PATH_WORDS[f], "role": _KIND_OF[f][0], "klass": _KIND_OF[f][1]}) for f in FILES])}),
docs AS (SELECT given.*, coalesce(facts, '') AS facts FROM given LEFT JOIN said ON doc_id = symbol_key)
"""
DOCUMENTS_SQL = f"WITH {_DOCUMENTS} SELECT doc_kind, doc_id, path, symbol, qualified, signature, keywords, facts, role, klass FROM docs"
COLUMNS = ["path", "symbol", "qualified", "signature", "keywords", "facts", "role", "klass"]
ASKED = [["limit"], ["make", "12"], ["deliver"], ["red"]]


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all eight columns of the built documents."""
    # scores and the collection's statistics both read the documents: they are joined once
    hits = search.bm25(indexer.stored(_documents(spark, sf_dir), scratch(spark)), text.spaced_words(F.concat_ws(" ", *COLUMNS)), ASKED)
    return search.candidates(hits, ["path", "doc_kind", "doc_id"], search.clamp_limit(1000)).select("doc_kind", "doc_id", "path", F.round("score", 6).alias("score"))


_COUNTS = [f"len(list_filter(w, lambda t: starts_with(t, '{p[0]}')))" if len(p) == 1 else f"len(list_filter(range(1, len(w)), lambda k: w[k] = '{p[0]}' AND starts_with(w[k + 1], '{p[1]}')))" for p in ASKED]
_IDF = "(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END)::DOUBLE * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avg_d))"
SEARCH_SQL = f"""
WITH {_DOCUMENTS}, worded AS (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', {", ".join(COLUMNS)})), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM docs),
counted AS (SELECT doc_kind, doc_id, path, len(w) AS d, {", ".join(f"{c} AS f{k}" for k, c in enumerate(_COUNTS))} FROM worded),
stats AS (SELECT count(*) AS n, avg(d) AS avg_d, {", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(ASKED)))} FROM counted),
scored AS (SELECT doc_kind, doc_id, path, ({" + ".join(_IDF.format(k=k) for k in range(len(ASKED)))})::DOUBLE AS score FROM counted, stats WHERE {" OR ".join(f"f{k} > 0" for k in range(len(ASKED)))})
SELECT doc_kind, doc_id, path, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, path, doc_kind, doc_id LIMIT 100
"""

# tags and names

#: kind of file, name, kind, scope, line, signature
TAGS = [
    ("module", "json", "i", "", 5, "import json"), ("module", "make_{before}", "i", "", 6, "from stock.part_{before} import make_{before}"), ("module", "LIMIT_{k}", "x", "", 8, "LIMIT_{k} = {size}"), ("module", "Part{k}", "c", "", 11, "class Part{k}(Base{size}):"),
    ("module", "make_{k}", "m", "Part{k}", 14, "def make_{k}(self, size: int) -> str:"), ("module", "check_{k}", "f", "", 21, "def check_{k}(value, depth=1):"), ("test", "check_{k}", "i", "", 1, "from stock.part_{k} import check_{k}"), ("test", "test_check_{k}", "f", "", 4, "def test_check_{k}(bench):"),
    ("generated", "value", "v", "", 1, "value = {k}"),
]
TAGS_SQL = union_sql([(f, {"path": FILES[f][2], "name": name, "kind": kind, "scope": scope, "line": f"={line}::INTEGER", "signature": signature}) for f, name, kind, scope, line, signature in TAGS])


def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.tag_rows(tree.described(spark, sf_dir))


def tag_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.member_rows(tree.described(spark, sf_dir))


#: kind of file, name, line
NAMES = [
    *(("module", name, line) for name, line in (("Base{size}", 11), ("LIMIT_{k}", 8), ("LIMIT_{k}", 16), ("ValueError", 17), ("dumps", 23), ("int", 14), ("json", 23), ("make_{before}", 18), ("size", 16), ("size", 18), ("str", 14), ("value", 22), ("value", 23))), ("test", "check_{k}", 5), ("generated", "value", 1),
]
_MODULE_OF = {"module": "stock.part_{k}", "test": "tests.test_part_{k}", "generated": "gen.region_{k}_pb2"}
NAMES_SQL = union_sql([(f, {"path": FILES[f][2], "module": _MODULE_OF[f], "name": name, "line": f"={line}::INTEGER"}) for f, name, line in NAMES])


def name_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.occurrence_rows(tree.described(spark, sf_dir))


# the built index: updates and operations

_CHANGED, _BLANK, _REMOVED, _ADDED = "p_partkey % 50 = 3", "p_partkey % 50 = 7", "p_partkey % 70 = 5", "p_partkey % 90 = 11"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree after an edit: some modules have another limit, some an empty line more, some are gone, some are new."""
    _, _, path, template, fields = FILES["module"]
    grown = {**fields, "size": ("cast(p_size + 1 as string)", "")}
    text_of = lambda f: tree.spark_text(template, f)
    parts = read(spark, sf_dir, "part", heavy=True)
    content = F.when(F.expr(_CHANGED), text_of(grown)).when(F.expr(_BLANK), F.concat(text_of(fields), F.lit("\n\n"))).otherwise(text_of(fields)).cast("binary")
    modules = parts.where(f"NOT ({_REMOVED})").select(tree.spark_text(path, fields).alias("path"), content.alias("content"))
    added = parts.where(_ADDED).select(tree.spark_text("src/more/extra_{k}.py", fields).alias("path"), tree.spark_text("def check_{k}(value):\n    return value\n", fields).cast("binary").alias("content"))
    return modules.unionByName(added).withColumn("byte_size", F.octet_length("content").cast("long")).unionByName(tree.files(spark, sf_dir, ("test",)))


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update did, and how many rows then differ from a clean build: none."""
    store = indexer.build(spark, tree.files(spark, sf_dir, ("module", "test")), scratch(spark))
    after = _edited(spark, sf_dir)
    generation = store.state()["generation"]
    counts = indexer.update(spark, after, store)
    counts["commits"] = store.state()["generation"] - generation
    counts |= {f"{name}_differ": len(rows) for name, rows in indexer.verify(spark, after, store).items()}
    return spark.createDataFrame(sorted(counts.items()), "what string, n long")


INDEX_UPDATE = f"""
WITH m AS (SELECT p_partkey, ({_REMOVED}) AS gone, NOT ({_REMOVED}) AND ({_CHANGED} OR {_BLANK}) AS edited, ({_ADDED}) AS added FROM part),
t AS (SELECT p_partkey, gone, added FROM m WHERE p_partkey % 10 = 0),
-- a module that imports one that went or came, unless it went or was edited itself; a test of one that went or got a double
near AS (SELECT n.p_partkey FROM m JOIN m n ON n.p_partkey = m.p_partkey + 1 WHERE m.gone AND NOT n.gone AND NOT n.edited)
SELECT 'changed' AS what, count(*) FILTER (edited)::BIGINT AS n FROM m UNION ALL SELECT 'removed', count(*) FILTER (gone) FROM m UNION ALL SELECT 'new', count(*) FILTER (added) FROM m
UNION ALL SELECT 'unchanged', (SELECT count(*) FILTER (NOT edited AND NOT gone) FROM m) + (SELECT count(*) FROM t)
UNION ALL SELECT 'same_structure', count(*) FILTER (edited AND {_BLANK}) FROM m
UNION ALL SELECT 'resolved_again', (SELECT count(*) FROM near) + (SELECT count(*) FILTER (gone OR added) FROM t)
UNION ALL SELECT 'commits', 1 UNION ALL SELECT 'symbols_differ', 0 UNION ALL SELECT 'facts_differ', 0 UNION ALL SELECT 'relationships_differ', 0
"""


def index_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of the protocol, asked line by line: whether each was answered, how much came and what came first."""
    engine = Engine(spark, scratch(spark))
    engine.store = indexer.build(spark, tree.files(spark, sf_dir), engine.store.folder)
    asked = [
        ("get_symbol", {"symbol": "part7.MAKE_7"}), ("get_dependencies", {"path": "src/stock/part_11.py"}), ("get_references", {"symbol": "make_6"}), ("get_tests", {"symbol": "check_11"}), ("get_docs", {"query": "deliver supplier 3 terms", "limit": 1}),
        ("get_context", {"symbol": "Part7.make_7"}), ("search", {"query": "make_7", "limit": 5}), ("get_stats", {}), ("get_symbol", {"symbol": " "}), ("search", {"query": "part", "limit": 0}), ("nothing", {}), ("shutdown", {}),
    ]
    rows = []
    for k, (op, args) in enumerate(asked):
        said = json.loads(engine.handle(json.dumps({"id": k, "op": op, "args": args})))
        found = said.get("result") or {}
        lists = [v for v in found.values() if isinstance(v, list)]
        first = next((x for v in lists for x in v), None)
        first = found.get("symbol") if op == "get_context" else str(found.get("files")) if op == "get_stats" else said["error"]["code"] if "error" in said else first.get("path") or first.get("symbol") if isinstance(first, dict) else first
        rows.append((k, op, said["ok"], sum(map(len, lists)) if op != "search" or not lists else min(1, len(lists[0])), first))
    return spark.createDataFrame(rows, "id long, op string, ok boolean, n long, first string")


INDEX_PROTOCOL = f"""
WITH edges AS ({RELATIONSHIPS_SQL}), symbols AS ({SYMBOLS_SQL}), facts AS ({FACTS_SQL}), imports AS ({IMPORTS_SQL}),
named AS (SELECT stable_key FROM symbols WHERE qualified_name = 'Part7.make_7')
SELECT 0::BIGINT AS id, 'get_symbol' AS op, true AS ok, count(*)::BIGINT AS n, min(path) AS first FROM symbols WHERE qualified_name = 'Part7.make_7'
UNION ALL SELECT 1, 'get_dependencies', true, (SELECT count(DISTINCT resolved_module) FROM imports WHERE path = 'src/stock/part_11.py') + (SELECT count(DISTINCT path) FROM imports WHERE target_path = 'src/stock/part_11.py'), (SELECT min(path) FROM imports WHERE target_path = 'src/stock/part_11.py')
UNION ALL SELECT 2, 'get_references', true, count(*), min(path) FROM edges WHERE target LIKE '%.make_6(size)' AND kind = 'CALLS'
UNION ALL SELECT 3, 'get_tests', true, count(*), min(path) FROM edges WHERE target LIKE '%:check_11(value,depth)' AND kind = 'TESTS'
UNION ALL SELECT 4, 'get_docs', true, 1, 'docs/supplier_0.md'
UNION ALL SELECT 5, 'get_context', true, (SELECT count(DISTINCT (kind, value)) FROM facts WHERE symbol_key IN (SELECT stable_key FROM named)), 'Part7.make_7'
UNION ALL SELECT 6, 'search', true, 1, 'src/stock/part_7.py'
UNION ALL SELECT 7, 'get_stats', true, 0, (SELECT count(DISTINCT path) FROM symbols)::VARCHAR
UNION ALL SELECT 8, 'get_symbol', false, 0, 'invalid_request' UNION ALL SELECT 9, 'search', false, 0, 'invalid_request' UNION ALL SELECT 10, 'nothing', false, 0, 'unsupported_op' UNION ALL SELECT 11, 'shutdown', true, 0, NULL
"""


QUERIES = {
    "tree_files": (tree_files, TREE_FILES), "tree_ignored": (tree_ignored, TREE_IGNORED), "tree_grep": (tree_grep, TREE_GREP), "index_symbols": (index_symbols, SYMBOLS_SQL), "index_facts": (index_facts, FACTS_SQL), "index_references": (index_references, REFS_SQL),
    "index_imports": (index_imports, IMPORTS_SQL), "index_relationships": (index_relationships, f"{_RELATIONSHIPS} SELECT {', '.join(EDGE)} FROM edges"), "index_tests_of": (index_tests_of, TESTS_OF),
    "index_tier_rates": (index_tier_rates, f"{_RELATIONSHIPS} SELECT tier, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM edges GROUP BY tier"), "index_lookup": (index_lookup, LOOKUP), "index_documents": (index_documents, DOCUMENTS_SQL), "index_search": (index_search, SEARCH_SQL),
    "tag_index": (tag_index, TAGS_SQL), "tag_members": (tag_members, f"WITH t AS ({TAGS_SQL}) SELECT t.path, o.name AS owner, t.name, t.kind, t.line FROM t JOIN t o ON t.path = o.path AND t.scope = o.name AND o.scope = '' AND o.kind IN ('c', 'f', 'm')"), "name_occurrences": (name_occurrences, NAMES_SQL),
    "index_update": (index_update, INDEX_UPDATE), "index_protocol": (index_protocol, INDEX_PROTOCOL),
}
