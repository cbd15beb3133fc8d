"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
import itertools

import pytest

import corpus_pipeline
from tesserae.llm import decontamination, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(docs in, docs out) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF).cache()
        out[name] = docs.collect(), done.collect()
        docs = done
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name][1][0].asDict().keys() == stages[name][0][0].asDict().keys()


def test_clean_documents_stay(stages):
    given, kept = stages["language ID"]
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_duplicates(stages):
    given, kept = stages["near-duplicates"]
    shingles = {r["doc_id"]: decontamination.exact_shingles(r["text"]) for r in given}
    label = {i: i for i in shingles}
    for a, b in itertools.combinations(sorted(shingles), 2):
        if jaccard(shingles[a], shingles[b]) >= simhash.NEAR_SIMILARITY:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert len(set(label.values())) < len(label) and {r["doc_id"] for r in kept} == set(label.values())


def test_decontamination(spark, stages):
    given, kept = stages["decontamination"]
    items = [decontamination.exact_shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in given if any(len(decontamination.exact_shingles(r["text"]) & i) >= 0.8 * len(i) - 1e-9 for i in items if i)}
    assert leaks and {r["doc_id"] for r in kept} == {r["doc_id"] for r in given} - leaks


def test_secrets_go(spark, stages):
    given, kept = stages["secret scan"]
    assert len(given) == len(kept)
    after = {r["doc_id"]: r for r in kept}
    changed = [r for r in given if after[r["doc_id"]]["text"] != r["text"]]
    assert all("[SECRET]" in after[r["doc_id"]]["text"] for r in changed)
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    left = secrets.digests(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")).where("spans <> ''")
    assert left.isEmpty()


def test_encoding(stages):
    given, kept = stages["byte-level BPE"]
    texts = {r["doc_id"]: r["text"] for r in given}
    assert len(kept) == len(texts)
    for r in kept:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_hard_rows_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "again the same id", "en", "s", 4), (2, "x " * 50_000, "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("documents", "benchmark"):
        (docs if name == "documents" else spark.createDataFrame([], "item_id long, text string")).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len([r for r in rows if r["doc_id"] == 1]) == 1
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
