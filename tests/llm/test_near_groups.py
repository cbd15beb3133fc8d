"""Near-duplicate groups against brute force: hot groups, recall by similarity, other kinds of ids."""

import itertools
import random

import pytest

from tesserae.llm import decontamination, simhash


def grouped(pairs, ids):
    label = {i: i for i in ids}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        if low != high:
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def copies(draw, base, n, most):
    """Copies of a text with up to so many words changed."""
    out = []
    for _ in range(n):
        text = list(base)
        for k in draw.sample(range(len(text)), draw.randrange(most + 1)):
            text[k] = words(draw, 1)[0]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_key_groups_lose_no_link(spark, monkeypatch, seed):
    """One key holds two far clusters, a chain and stragglers, in many chunks."""
    monkeypatch.setattr(simhash, "CELL", 16)
    draw = random.Random(seed)
    fps = [draw.choice((0, (1 << 40) - 1)) ^ sum(1 << b for b in draw.sample(range(40), draw.randrange(4))) for _ in range(150)]
    fps += [((1 << 4 * k) - 1) & ((1 << 40) - 1) | 0b1010 << 36 for k in range(9)] + [draw.getrandbits(40) for _ in range(40)]
    prints = spark.createDataFrame([(k, x.to_bytes(8, "big")) for k, x in enumerate(fps)], "doc_id long, fp binary")
    expected = grouped([(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4], range(len(fps)))
    one_key = lambda rows, radius, bits: [[(0, 24)]]  # noqa: E731  all agree on these bits
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(prints, 4, keys=one_key).collect()}
    assert got == expected and len(set(expected.values())) > 3


def near_texts(seed):
    draw = random.Random(seed)
    texts = copies(draw, words(draw, 150), 60, 3) + copies(draw, words(draw, 80), 30, 2) + [" ".join(words(draw, 60)) for _ in range(30)]
    return texts + texts[:5] * 3 + ["", "a b", "a b", None]


@pytest.mark.parametrize("small", [False, True])
def test_near_groups(spark, monkeypatch, small):
    if small:
        for name, value in {"CELL": 12, "VERIFY_CELL": 8}.items():
            monkeypatch.setattr(simhash, name, value)
    texts = near_texts(5)
    sets = [decontamination.exact_shingles(t or "") for t in texts]
    expected = grouped([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b])], range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = {r["doc_id"]: r["component_id"] for r in simhash.exact_near_groups(docs).collect()}
    assert exact == expected
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert sum(got[i] == expected[i] for i in got) >= 0.97 * len(texts)


def test_recall_by_similarity(spark):
    """Of pairs at 0.80 to 0.85 and above, nearly all are found; none below the threshold."""
    draw, pairs, texts = random.Random(9), [], []
    while len(pairs) < 300:
        base = words(draw, 120)
        other = copies(draw, base, 1, 6)[0]
        a, b = (decontamination.exact_shingles(x) for x in (" ".join(base), other))
        pairs.append((len(texts), len(a & b) / len(a | b)))
        texts += [" ".join(base), other]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 1.01)):
        band = [i for i, s in pairs if low <= s < high]
        assert len(band) > 20 and sum(got[i + 1] == i for i in band) >= 0.97 * len(band)
    assert not any(got[i + 1] == i for i, s in pairs if s < 0.8)


def test_ids_of_other_types_and_clashing_columns(spark):
    texts = near_texts(7)
    rows = [(f"id{k:03}", t, 1, "x", "y") for k, t in enumerate(texts)] + [(None, texts[0], 1, "x", "y")]
    docs = spark.createDataFrame(rows, "name string, text string, _mark int, _id string, node string")
    kept = simhash.keep_one(docs, "name")
    assert kept.columns == docs.columns
    groups = {r["name"]: r["component_id"] for r in simhash.near_groups(docs.where("name is not null"), "name").collect()}
    assert sorted(r["name"] or "" for r in kept.collect()) == sorted([*set(groups.values()), ""])


def test_ids_with_two_texts_do_not_join_them(spark):
    draw = random.Random(3)
    a, b, c, d = (" ".join(words(draw, 40)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (5, d)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert sorted(r["text"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id > 3").collect()) == sorted([c, d])
