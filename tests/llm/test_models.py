"""Models against plain loops: added secret spans, severities, attention scores."""

import math
import re
import tracemalloc

import numpy as np
import pytest

from treestat.llm import graph, quality, secrets, toxicity
from treestat.llm.tables import table
from treestat.session import written

SF = "/root/testdata/sf0.001"


def plain_base(t):
    out = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN.removeprefix("(?i)"), t, re.I | re.A) if len(m[2]) >= 8]
    return out + [(m.start(), m.end()) for p in (r"AKIA[A-Z0-9]+", r"[0-9a-f]+") for m in re.finditer(p, t) if m.end() - m.start() >= (16 if p[0] == "A" else 32)]


def plain_added(t, ratios, least):
    """Candidate runs less what base spans cover, scored character by character."""
    n, out = len(secrets.ALPHABET), []
    base = plain_base(t)
    for m in re.finditer(secrets.CANDIDATE, t):
        free = [not any(a <= k < b for a, b in base) for k in range(m.start(), m.end())]
        k = 0
        while k < len(free):
            if not free[k]:
                k += 1
                continue
            e = k
            while e < len(free) and free[e]:
                e += 1
            value = m[0][k:e]
            score = sum(ratios[secrets.ALPHABET.index(a) * n + secrets.ALPHABET.index(b)] for a, b in zip(value, value[1:]))
            if len(value) >= secrets.CANDIDATE_CHARS and score >= least:
                out.append((m.start() + k, m.start() + e))
            k = e
    return sorted(out)


def test_added_spans_equal_plain_scores(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rng = np.random.default_rng(4)
    random = lambda k: "".join(secrets.ALPHABET[i] for i in rng.integers(0, 62, k))
    own = [(10**9 + k, f"id {random(24)} and internationalization_settings_manager {random(19)} password={random(12)}{'/' + random(30)} end {random(45)}") for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame(own + [(10**9 + 99, None)], "doc_id long, text string"))
    model = secrets.train(secrets.scan(docs), docs)
    ratios = [float(f"{x:.6f}") for x in model]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["added"]) for r in secrets.find_secrets(docs).collect()}
    assert found == {k: plain_added(t, ratios, secrets.MIN_RATIO) for k, t in texts.items()}
    assert sum(map(len, found.values())) >= 40


def test_severity_equals_plain_sums(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels)
    assert model.weight and model.thresholds == sorted(model.thresholds)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.severity(docs, labels).collect():
        seen = {f for w in set(re.findall(r"[^\W\d_]+", texts[r["doc_id"]].lower())) for f in toxicity.features(w)}
        s = sum(model.weight[f] for f in seen if f in model.weight)
        above = [1 / (1 + math.exp(min(60, max(-60, t - s)))) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        shares = [1 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0]))]
        assert shares[r["grade"]] == pytest.approx(max(shares)) and r["toxic"] == (above[0] >= toxicity.CUT)


def test_fit_lowers_the_ordinal_loss():
    """The fitted weights are near a stationary point of the loss: no step along a coordinate lowers it much."""
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 40, 12) + (1000 if k % 3 == 0 and i < 6 else 0)).astype(np.int64) for k in range(300) for i in (k % 10,)]
    toxic = np.array([int(k % 3 == 0 and k % 10 < 6) for k in range(300)])
    m = toxicity.fit(lists, toxic)
    p = np.array([1 / (1 + np.exp(m.thresholds[0] - sum(m.weight.get(int(f), 0.0) for f in x))) for x in lists])
    assert p[toxic == 1].min() > 0.5 > p[toxic == 0].max()
    assert toxicity.fit(lists, np.zeros(300, int)).thresholds == [50.0] * toxicity.GRADES


def test_attention_equals_plain_loop():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(rng.integers(1, 6), quality.N_FEATURES)).astype(np.float32) for _ in range(40)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    m = quality.fit(bags, y, epochs=5)
    sig = lambda x: 1 / (1 + np.exp(-x))
    got = quality.forward(m, np.concatenate(bags), np.repeat(np.arange(40), [len(b) for b in bags]))["p"]
    for b, p in zip(bags, got):
        hs = [np.tanh(((x - m["mean"]) / m["std"]) @ m["E"] + m["e"]) for x in b]
        e = np.array([(np.tanh(h @ m["V"]) * sig(h @ m["G"])) @ m["u"] for h in hs])
        a = np.exp(e) / np.exp(e).sum()
        assert p == pytest.approx(float(sig(sum(w * h for w, h in zip(a, hs)) @ m["c"] + m["d"][0])), rel=1e-5)


def test_score_at_the_cut():
    """A score of exactly the cut is predicted 1; a constant model scores every text alike."""
    assert quality.score(0.3, [b"x", b""]) == [0.3, 0.3] and quality.CUT == 0.3

def test_training_leaves_the_features_with_the_tasks(spark):
    """The model is that of all feature lists at once, but the driver never holds them."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    tracemalloc.start()
    model = toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    known = {}
    for r in labels.filter("toxic IS NOT NULL").collect():
        known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.filter("doc_id IS NOT NULL").collect() if r["doc_id"] in known)
    lists = [np.array(sorted({f for w in toxicity.words_of(t) for f in toxicity.features(w)}), np.int64) for _, t in rows]
    whole = toxicity.fit(lists, np.array([int(known[k] > 0) for k, _ in rows]))
    assert model.weight == pytest.approx(whole.weight) and model.thresholds == pytest.approx(whole.thresholds)


def test_rounds_of_components_broadcast_nothing(spark):
    edges = written(spark.createDataFrame([(3, 1), (5, 3), (5, 2)], "x long, y long"), "edges")  # so that its size is known
    for step in (graph._large_star, graph._small_star):
        assert "Broadcast" not in step(edges)._jdf.queryExecution().executedPlan().toString()
    found = graph.components(edges.toDF("a", "b"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(2, 1), (3, 1), (5, 1)}
