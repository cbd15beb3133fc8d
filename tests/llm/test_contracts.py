"""The registered queries against brute force, on the small table and on hard rows."""

import binascii
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm import registry

SF = "/root/testdata/sf0.001"
HARD = [
    (None, "no id"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "same words here now again"), (9005, "same words here now again"),
    (9006, "İK K ſecret token: abcdefg password='x' passwd=\"abcdef\" token=token:abcdef AKIA" + "A" * 30 + " " + "0f" * 20),
    (9007, "𝔘nicode 𝒶 api_key = 12345678 ü token=abcdefgh" * 3), (9008, "word " * 30_000), (9009, "MIT License, the mit-license; mit license GNU General  Public\nLicense v3 and Apache License 2.0 mit license mit license"),
    (9010, "a" * 200_000), (9011, "\x85x\x1cy z \x0bq"), (9012, "héllo wörld  double  spaces 'tis it's 42 ½ ²³ \r\n end "), (9013, "👩‍👩‍👧 fam 日本語テキスト"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of the small scale with hard rows and extra columns of clashing names."""
    top = tmp_path_factory.mktemp("hard")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in HARD], docs.schema)
    from pyspark.sql import functions as F

    more = {c: F.lit(c) for c in ("node", "fp", "root", "spans", "key", "shard", "_key", "rank", "component_id", "language", "host", "ids")}
    docs.unionByName(hard).withColumns(more).write.parquet(f"{top}/documents.parquet")
    for name in ("benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, folder, name):
    query = next(f for k, f in registry.queries().items() if k.startswith(f"{name}_"))
    return query(spark, folder).collect()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_op1(spark, folder):
    from tesserae.llm import chat

    turns = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    turns += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    expected = {}
    for conv, group in itertools.groupby(sorted(turns), key=lambda x: x[0]):
        group = list(group)
        loss = "".join(t for _, _, r, t in group if r == "assistant")
        whole = "".join(chat.format_turn(r, t) for _, _, r, t in group)
        assert chat.read_turns(whole) == [(r, t) for _, _, r, t in group]
        expected[conv] = (len(group), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in group).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    assert {r[0]: tuple(r)[1:] for r in run(spark, folder, "op1")} == expected


def test_op2(spark, folder, docs):
    rows = run(spark, folder, "op2")
    of_docs = [r for r in rows if r["page_id"] is None]
    assert len(of_docs) == len(docs) and len(rows) == len(docs) + spark.read.parquet(f"{folder}/pages.parquet").count()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    right = [r["text_language"] == truth[r["doc_id"]] for r in of_docs if r["doc_id"] in truth]
    assert sum(right) >= 0.97 * len(right)
    assert all(r["accepted"] for r in of_docs if r["doc_id"] in truth)


def fingerprint3(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark, folder, docs):
    prints = [(i, fingerprint3(t)) for i, t in docs]
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    expected = Counter((i, f"{p:016x}", least.get(find(p))) for i, p in prints)
    assert bag(run(spark, folder, "op3")) == expected


def test_op4(spark, folder):
    codes = {r["vec_id"]: sum(1 << k for k, x in enumerate(r["embedding"]) if x > 0) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    expected = Counter()
    for q in (x for x in codes if x % 50 == 0):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:10]
        expected.update((q, k + 1, i, d) for k, (d, i) in enumerate(near))
    assert bag(run(spark, folder, "op4")) == expected


def spans5(text):
    from tesserae.llm.secrets import ADDED

    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(out)
    for k, rule in enumerate(ADDED):
        out += [(m.start(), 3 + k, rule.kind, m.end()) for m in re.compile(rule.pattern, re.A).finditer(text)]
    return base, sorted(out)


def ascii_only(pattern_text):
    """Python's (?i) also folds U+212A and U+017F into k and s; they must not count here."""
    return pattern_text.replace("K", "?").replace("ſ", "?")


def test_op5(spark, folder, docs):
    said = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, k, b in x)
    expected = Counter()
    for i, t in docs:
        base, every = spans5(ascii_only(t))
        n = Counter(x[2] for x in base)
        expected[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(said(base).encode()).hexdigest(), said(every))] += 1
    assert bag(run(spark, folder, "op5")) == expected


def test_op6(spark, folder, docs):
    from tesserae.llm.lm import DISCOUNT, SHARE

    tokens = lambda t: [*t.encode().lower().split(), None]
    training = [tokens(t) for i, t in docs if i is not None and binascii.crc32(str(i).encode()) % 5 != 1]
    one, two, three = Counter(), Counter(), Counter()
    for x in training:
        one.update(x)
        two.update(itertools.pairwise(x))
        three.update(zip(x, x[1:], x[2:], strict=False))
    total, kinds = sum(one.values()), len(one)
    after = Counter((a, b) for a, b, _ in three)
    rows = defaultdict(list)
    for r in run(spark, folder, "op6"):
        rows[r["doc_id"]].append(r)
    assert sum(map(len, rows.values())) == len(docs)
    for i, t in docs:
        x = tokens(t)
        r = rows[i][0]
        assert r["held_out"] == (i is None or binascii.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(one[w] > 0 for w in x), total)
        base = score = 0.0
        for k, w in enumerate(x):
            p = (one[w] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            if k and one[x[k - 1]]:
                p = (1 - SHARE) * p + SHARE * two[x[k - 1], w] / one[x[k - 1]]
            if k > 1 and two[x[k - 2], x[k - 1]]:
                n = two[x[k - 2], x[k - 1]]
                p = max(three[x[k - 2], x[k - 1], w] - DISCOUNT, 0) / n + DISCOUNT * after[x[k - 2], x[k - 1]] / n * p
            score += math.log10(p)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-3, abs=1e-3)


def test_op7(spark, folder, docs):
    rows = defaultdict(list)
    for r in run(spark, folder, "op7"):
        rows[r["doc_id"]].append(r)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = sorted((k, name) for phrase, name in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase)
        r = rows[i][0]
        base = sorted({n for _, n in at})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(base)), i
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    hard = rows[9009][0]
    assert {"gpl-3.0", "apache-2.0", "mit"} <= set(hard["labels"].split(","))


def test_op8(spark, folder, docs):
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    items = [(r["item_id"], shingles(r["text"] or "")) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = Counter()
    for i, t in docs:
        s = shingles(t)
        for k, x in items:
            if x and len(s & x) >= 0.8 * len(x) - 1e-9:
                expected[(i, k, len(s & x), len(x), len(s & x) / len(x))] += 1
    assert expected and bag(run(spark, folder, "op8")) == expected


def test_op9(spark, folder, docs):
    rows = run(spark, folder, "op9")
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t.encode()) + 1, binascii.crc32(t.encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert bag(rows) == bag(run(spark, folder, "op9"))


def test_op10(spark, folder, docs):
    import numpy as np
    import public_tokenizers
    import tiktoken

    from tesserae.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path(registry.VOCABULARY))
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, t in docs:
        ids = engine.encode_ordinary(t)
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert bag(run(spark, folder, "op10")) == expected


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = run(spark, str(tmp_path), name)
    assert len(rows) == (1 if name == "op1" else 0)
