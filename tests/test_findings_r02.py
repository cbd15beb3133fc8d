"""What the findings of round 2 named."""

from pyspark.sql import functions as F

from tesserae import api, extract, indexer
from tesserae.plans import tree

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_one_list_is_found_without_the_others(spark):
    """F9 to F12: a query of one list gets the rows that a whole parse gives."""
    files = tree.described(spark, SF, ("module", "test", "page"))
    whole = extract.extract(files).cache()
    for name, fields in (("symbols", ["stable_key", "kind", "signature", "line_end"]), ("facts", ["symbol_key", "kind", "value"]), ("refs", ["source_key", "name", "arity"])):
        assert rows(extract.extract_rows(files, name, fields)) == rows(extract.exploded(whole, name).select("path", *fields))
    assert extract.extract(files, {"imports": None, "refs": ["name"]}).columns == ["path", "imports", "refs"]
    whole.unpersist()


def test_a_task_holds_a_slice_of_files(spark):
    """batches of few files, whatever the session's number of rows is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    extract.extract_rows(tree.described(spark, SF, ("page",)), "refs", ["name"])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= extract.BATCH_ROWS


def test_left_rows_without_a_key_are_spread(spark):
    """edges that lead outside have no target, and must not meet in one task."""
    from tesserae.operators import joins

    left = spark.range(2000).select("id", F.when(F.col("id") < 3, F.col("id").cast("string")).alias("k")).repartition(4)
    right = spark.createDataFrame([("0", "a"), ("2", "b")], "k string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = joins.join_present(left, right, "k")
        assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
        assert rows(met.select("id", "k", "v")) == rows(left.join(right, "k", "left").select("id", "k", "v"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_module_is_sought_once(spark):
    """imports of one module by many files share one search for its file."""
    imports = spark.range(50).select(F.concat(F.lit("src/m"), "id", F.lit(".py")).alias("path"), F.lit("a.b").alias("module"), F.lit(0).alias("level"), F.lit(1).alias("line"))
    files = spark.createDataFrame([("src/a/b.py",), ("src/a/b.md",)], "path string")
    assert {r["target_path"] for r in indexer.import_targets(imports, files).collect()} == {"src/a/b.py"}


def test_members_of_one_file(spark):
    """members are found beside their owners."""
    text = "class A:\n    def f(self):\n        pass\nclass A:\n    x = 1\ndef f():\n    def g():\n        pass\n"
    files = spark.createDataFrame([("a.py", text, "python"), ("b.md", "# b", "markdown")], "path string, content_text string, language string")
    assert rows(extract.member_rows(files)) == rows(extract.members(extract.tag_rows(files)))


def test_the_name_asked_for_comes_first(spark, tmp_path):
    """F8: thousands of names that begin with the one that was asked for, and score as high, do not push it out."""
    engine = api.Engine(spark, str(tmp_path))
    name = F.concat(F.lit("make_7"), F.when(F.col("id") == 600, "").otherwise(F.col("id").cast("string")))
    docs = spark.range(601).select(F.lit("symbol").alias("doc_kind"), name.alias("doc_id"), F.concat(F.lit("src/"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".py")).alias("path"), name.alias("symbol"), name.alias("qualified"), F.lit("").alias("signature"), F.lit("").alias("keywords"), F.lit("").alias("facts"), F.lit("function").alias("role"), F.lit("source").alias("klass"))
    engine.table = lambda _: docs
    assert engine.search_rows("make_7", 5).first()["symbol"] == "make_7"


def test_the_longest_suffix_without_a_second_shuffle(spark):
    """one join by the key, whose tasks follow from the input."""
    from tesserae.functions import text
    from tesserae.operators import joins

    found = spark.createDataFrame([(1, 1, "m.A.f"), (1, 1, "m.A.f"), (1, 2, "f"), (2, 1, "x.f")], "probe long, rank int, symbol string")
    gold = spark.createDataFrame([(1, "f"), (1, "A.f"), (1, "g"), (3, "f")], "probe long, gold string")
    met = joins.suffix_matches(found, gold, ["probe"], "symbol", "gold", text.dotted_suffixes, 5)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(tuple(r) for r in met.collect()) == [(1, 1, "m.A.f", "A.f"), (1, 2, "f", "f")]


def test_a_term_has_one_source(spark):
    """F16: the source of a term is chosen inside the row, not by a shuffle of all terms of both."""
    from tesserae.operators import keywords

    docs = spark.createDataFrame([(1, "Big title\nbody words title", "Big title"), (2, None, None)], "doc_id long, text string, head string")
    assert sorted(tuple(r) for r in keywords.sourced_terms(docs, "doc_id", "text", "head").collect()) == [(1, "big", "heading"), (1, "body", "body"), (1, "title", "heading"), (1, "words", "body")]


def test_an_update_starts_each_step_at_files(spark, tmp_path):
    """tables follow from those that were written, so that no step runs again for the next one; nothing is left beside the generations."""
    source = lambda **more: spark.createDataFrame([(path, bytearray(text.encode()), len(text)) for path, text in ({f"src/m{k}.py": f"from m{k - 1} import f{k - 1}\n\n\ndef f{k}(x):\n    return f{k - 1}(x)\n" for k in range(6)} | more).items()], "path string, content binary, byte_size long")
    store = indexer.build(spark, source(), str(tmp_path / "index"))
    spark.sparkContext.setJobGroup("update", "update")
    edited = source(**{"src/m3.py": "def g3(x):\n    return x\n"})
    assert indexer.update(spark, edited, store) == {"changed": 1, "unchanged": 5, "same_structure": 0, "resolved_again": 1}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("update"))
    assert jobs < 180  # 329 when each table was computed from the source
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["current.json", "generation=1", "generation=2"]


def test_a_limit_that_is_met_exactly(spark):
    """a coefficient of variation of 0.2 or 0.05 is not over it, in whatever order the values come, and a great mean takes nothing from the deviation."""
    from tesserae.operators import statistics

    values = [(k, float(v) * 10**9) if k == 9 else (k, float(v)) for k, group in enumerate(([35, 23, 35, 27], [23, 27, 35, 35], [27, 35, 35, 23], [35, 35, 27, 23], [38, 42, 40, 42, 38], [39, 41, 40], [2, 2], [7], [1, 2, 4], [35, 23, 35, 27])) for v in group]
    values += [(10, 1e9 + v) for v in (0.25, 0.5, 0.75)]
    told = {r["k"]: r for r in statistics.dispersion(spark.createDataFrame(values, "k int, v double").coalesce(1), "k", "v").collect()}
    assert [told[k]["stdev"] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [6.0, 6.0, 6.0, 6.0, 2.0, 1.0, 0.0, 0.0, 1.527525, 6e9, 0.25]
    assert [told[k]["stability"] for k in (0, 1, 2, 3, 9)] == ["noisy"] * 5
    assert told[4]["stability"] == "stable"


def test_probes_walk_the_documents_once(spark):
    """metrics read the hits, however often, and not the texts; a document with the words twice counts twice, one without the rest is no gold."""
    from tesserae.plans import analytics

    assert not [f for f in analytics.worst_case_mean(spark, SF).inputFiles() if "documents.parquet" in f]
    docs = spark.createDataFrame([(1, "A b c d e f g h, c d e"), (2, "c d e"), (3, "a b c d e f g"), (4, "a b"), (5, None), (6, "a b c d e f g h a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i"), (8, "too short c d e")], "item_id long, text string")
    assert sorted(tuple(r) for r in analytics._probe_hits(docs, items).collect()) == [(7, 1, 2, True), (7, 2, 1, False), (7, 3, 1, False), (7, 6, 2, True)]


def test_documents_are_joined_once_for_a_search(spark):
    """scores and statistics read documents that were written, and neither joins symbols, facts and keywords again."""
    from tesserae.plans import index

    plan = index.index_search(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("Join") == 1  # with the one row of statistics
