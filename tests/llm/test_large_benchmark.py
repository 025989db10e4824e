"""A benchmark that no task holds: the same leaks as one index gives, whatever the number of items."""

import random

import pytest
from pyspark.sql import functions as F

from treestat.llm import decontaminate


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    items = [(k, text(rng, rng.choice([1, 3, 5, 8, 20, 60]))) for k in range(5000)]
    items += [(5000 + k, items[k][1]) for k in range(40)] + [(6000, None), (6001, "--"), (None, items[7][1])]
    docs = []
    for k in range(400):
        w = text(rng, rng.randrange(0, 150)).split()
        for _ in range(rng.randrange(3)):
            inner = items[rng.randrange(5040)][1].split()
            if len(inner) > 9 and rng.random() < 0.5:
                inner[rng.randrange(len(inner))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = inner
        docs.append((k, " ".join(w)))
    docs += [(400, None), (401, ""), (None, items[3000][1]), (402, items[4999][1]), (402, items[4999][1]), (403, " ".join(items[30][1].split()[:55]))]
    docs.append((404, " . ".join(t for _, t in items[100:600])))  # one document with very many items
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_leaks_equal_one_index(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 100_000)
    one = rows(decontaminate.leaks(docs, items))
    kept = rows(decontaminate.keep_clean(docs, items))
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 1000)
    monkeypatch.setattr(decontaminate, "_collected", None)  # nothing is collected
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    assert rows(decontaminate.leaks(docs, items)) == one and len(one) > 400
    assert rows(decontaminate.keep_clean(docs, items)) == kept and 50 < len(kept) < 380


def test_plan_does_not_grow_with_items(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "GROUP_ITEMS", 10)
    size = lambda n: len(decontaminate.leaks(docs.limit(3), items.filter(F.col("item_id") < n))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(20) == size(2000)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 100])
def test_prefix_loses_no_window(n):
    k = decontaminate.prefix(n, 0.8)
    assert n - k + 1 >= 0.8 * n - 1e-9 and (k == 1 or n - (k - 1) < 0.8 * n + 1)
