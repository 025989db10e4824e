"""Crowded buckets of the MinHash operator: cut up by rare shingles, no link lost, few pairs compared."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from treestat.llm import minhash
from treestat.llm.shingles import shingles, weighted_jaccard, words


def groups_of(texts):
    """Least member of each group, by comparing all pairs."""
    sh, at = shingles(*words(texts))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if weighted_jaccard(sh[at[i] : at[i + 1]], sh[at[j] : at[j + 1]]) >= 0.8:
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in range(len(texts))}


def changed(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def crowd():
    """Strangers that share a long passage, two families that share it too, pairs near 0.8, repeated words, short texts."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(120)
    texts = [passage + new(80) for _ in range(120)]
    for _ in range(2):
        base = passage + new(80)
        texts += [changed(rng, base, rng.randrange(3)) for _ in range(40)]
    for k in range(30):
        texts.append(changed(rng, texts[k], rng.randrange(1, 6)))
    texts += [new(3) * 60 for _ in range(6)] + [["a", "b"] * k for k in (30, 34, 36, 40, 60)] + [["one"], ["one"], ["one", "two"]]
    rng.shuffle(texts)
    return [" ".join(w) for w in texts]


@pytest.fixture()
def one_bucket(monkeypatch):
    real = minhash.signatures

    def one_band(sh, at, k=168):  # all texts share the first band and agree in nothing else
        sig = real(sh, at, k)
        for row, a, b in zip(sig, at[:-1], at[1:]):
            row[:7], row[7:] = 1, np.random.default_rng(int(sh[a:b].sum())).integers(1, 2**62, k - 7)
        return sig

    monkeypatch.setattr(minhash, "signatures", one_band)


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_prefixes_of_similar_texts_meet(crowd, cells):
    sh, at = shingles(*words(crowd))
    rarity = np.bincount((sh % np.uint64(cells)).astype(np.int64), minlength=cells)
    p = [set(x.tolist()) for x in minhash._prefixes(sh, at, rarity, 0.8)]
    alike = [(i, j) for i, j in combinations(range(len(crowd)), 2) if weighted_jaccard(sh[at[i] : at[i + 1]], sh[at[j] : at[j + 1]]) >= 0.8]
    assert len(alike) > 1000 and all(p[i] & p[j] for i, j in alike)
    assert all(len(x) == n - int(np.ceil(0.8 * n - 1e-9)) + 1 for x, n in zip(p, np.diff(at)))


def test_prefixes_of_texts_without_words():
    sh, at = shingles(*words(["", "--", "a b c d e f"]))
    assert [len(x) for x in minhash._prefixes(sh, at, np.zeros(8, np.int64), 0.8)] == [0, 0, 1]
    assert [len(x) for x in minhash._prefixes(*shingles(*words(["", ""])), np.zeros(8, np.int64), 0.8)] == [0, 0]


def test_crowded_buckets_lose_no_link(spark, crowd, one_bucket, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 500)
    df = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in minhash.groups(df).collect()} == groups_of(crowd)


def test_strangers_are_not_compared(spark, crowd, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 500)
    n = len(crowd)
    texts = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, t string")
    main, size = Counter(groups_of(crowd).values()).most_common(1)[0]
    rows = [(7, 0, k, g, main, n, n - size) for k, g in groups_of(crowd).items()]
    mixed = spark.createDataFrame(rows, "key long, band int, rep long, root long, main long, n long, outside long")
    out = minhash._cut_up(mixed, texts, 0.8)
    assert out.columns == mixed.columns
    pairs = out.groupBy("key").agg((F.max("n") * F.max("outside")).alias("p")).agg(F.sum("p")).first()[0] or 0
    assert pairs < n * (n - size) / 50  # those of the whole bucket
    monkeypatch.setattr(minhash, "CROWD", 1 << 24)
    assert minhash._cut_up(mixed, texts, 0.8) is mixed
