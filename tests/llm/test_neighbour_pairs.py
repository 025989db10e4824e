"""Single pairs among strangers, crowded buckets and colliding labels: links against brute force."""

import numpy as np
import pandas as pd
import pytest

from treestat.llm import neighbours


def frame(spark, x, labels=0):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": labels, "embedding": [v.tolist() for v in x]}))


def near(rng, a, low, high):
    """A vector whose cosine with ``a`` lies between the bounds."""
    t = rng.normal(size=len(a))
    t -= t @ a * a
    c = rng.uniform(low, high)
    return c * a + np.sqrt(1 - c * c) * t / np.linalg.norm(t)


def check(spark, x):
    link = x @ x.T >= neighbours.LEAST
    np.fill_diagonal(link, False)
    got = neighbours.links(frame(spark, x)).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == link.sum(1)).all() and link.any()


@pytest.mark.parametrize("seed", [1, 2])
def test_single_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(600):
        x[-1 - k] = near(rng, x[k], 0.9801, 0.985)
    check(spark, x)


def test_pairs_in_crowded_buckets(spark):
    """All vectors lean to one side, so a bucket of the label's signs holds most of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 48)) * 0.35 + np.eye(48)[0] * 2
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(300):
        x[-1 - k] = near(rng, x[k], 0.9803, 0.99)
    check(spark, x)


def test_labels_are_compared(spark):
    """Candidates across labels, as a collision of bucket keys would give them, are no links."""
    nodes = spark.createDataFrame([(k, label, np.array([1.0, 0.0]).tobytes()) for k, label in ((1, 7), (2, 7), (3, 8))], "v long, label long, x64 binary")
    lists = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "v long, u long, s double")
    assert [tuple(r) for r in neighbours._links(lists, nodes, 0.98).collect()] == [(1, 2)]
