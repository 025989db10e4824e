"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of at most ``PASSAGE_WORDS`` words. Each passage is described by counts over its words
and bytes (repetition, capitals, classes of signs, lengths), encoded by a learned layer h = tanh(Ex + e). Gated
attention a = softmax(u.(tanh(Vh) * sigmoid(Gh))) weighs the passages, and the weighted encoding gives the score
sigmoid(c.sum(ah) + d). Encoder, attention and output are learned together from document labels alone.

The model is fitted on at most ``TRAIN_DOCS`` labelled documents (smallest hash of doc_id) among those whose
crc32(doc_id as text) mod 5 is not 0. Every document is scored over its whole text.

Defined cases: a NULL or empty text is one passage without words. NULL labels are skipped; several labels of a doc_id
count as their greatest. Without labels of both classes every score is the share of label 1 (0.5 without labels). Very
long texts are just many passages. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treestat.llm.tables import add_columns

TRAIN_DOCS = 6000
PASSAGE_WORDS = 64
CUT = 0.3
SLICE_BYTES = 4_000_000
#: Classes of signs that are counted apart.
SIGNS = (".,;:", "!", "?", "'\"()-", "|", "#", "$", "%", "&", "*", "<>[]{}", "=+~^`\\/_@")
_HIDDEN, _GATE = 16, 8


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 lower, 2 upper, 3 digit, 4 non-ASCII, 5 control, then the signs."""
    c = np.full(256, 5)
    for k, chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, range(128, 256)), (0, b" \t\n\r\x0b\x0c")):
        c[list(chars)] = k
    for k, chars in enumerate(SIGNS):
        c[list(chars.encode())] = 6 + k
    return c


_CLASS = _classes()
_N = 6 + len(SIGNS)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
N_FEATURES = _N - 1 + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and, for each, the index of its text; every text has at least one passage."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    cls = _CLASS[data]
    gap = cls == 0
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    owner = np.searchsorted(np.cumsum(sizes), first, side="right")
    out, doc = [np.zeros((0, N_FEATURES))], [np.empty(0, np.int64)]
    if n := len(first):
        new_doc = np.concatenate([[True], owner[1:] != owner[:-1]])
        rank = np.arange(n) - np.maximum.accumulate(np.where(new_doc, np.arange(n), 0))
        head = np.flatnonzero(rank % PASSAGE_WORDS == 0)
        words = np.diff(np.append(head, n))
        length = last - first
        # counts of classes over each passage, from running sums
        bounds = first[head]
        ends = last[np.append(head[1:] - 1, n - 1)]
        counts = np.empty((len(head), _N))
        upper2 = (np.concatenate([[0], data[:-1]]) == 0xC3) & (data >= 0x80) & (data <= 0x9E)
        for k in range(_N):
            run = np.concatenate([[0], np.cumsum((cls == k) | upper2 if k == 2 else cls == k)])
            counts[:, k] = run[ends] - run[bounds]
        chars = np.maximum(1, counts[:, 1:].sum(1))
        # words by hash: bytes times the powers of their places
        at = np.arange(len(data)) - np.maximum.accumulate(np.where(~gap & np.concatenate([[True], gap[:-1]]), np.arange(len(data)), 0))
        value = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[at % 64])
        code = np.add.reduceat(value, first) + length.astype(np.uint64)
        mean = lambda x: np.add.reduceat(x.astype(float), head) / words
        same = [np.concatenate([np.zeros(k, bool), (code[k:] == code[:-k]) & (owner[k:] == owner[:-k])])[:n] for k in (1, 2, 3)]
        close = last - 1
        f = [
            *(counts[:, 1:] / chars[:, None]).T,
            *(mean(x) for x in same),
            np.minimum(mean(length), 40) / 10,
            mean(length == 1),
            mean(cls[close] >= 6),
            mean((cls[first] == 2) | upper2[np.minimum(first + 1, len(data) - 1)]),
            np.log1p(words) / 4,
        ]
        out.append(np.stack(f, 1))
        doc.append(owner[head])
    bare = np.setdiff1d(np.arange(len(texts)), owner)
    out.append(np.zeros((len(bare), N_FEATURES)))
    doc.append(bare)
    x, d = np.concatenate(out), np.concatenate(doc)
    order = np.argsort(d, kind="stable")
    return x[order].astype(np.float32), d[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(e: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    x = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    return x / np.add.reduceat(x, starts)[doc]


def forward(m: dict, x: np.ndarray, doc: np.ndarray) -> dict:
    """All layers for passages ``x`` of documents ``doc`` (0, 1, ... without gaps, ascending)."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    x = (x - m["mean"]) / m["std"]
    h = np.tanh(x @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["G"])
    a = _softmax((t * g) @ m["u"], starts, doc)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"]), "starts": starts}


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict | float:
    """Learn from bags of passages; the share of label 1 where there is one class alone."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    m = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in (("E", (N_FEATURES, _HIDDEN)), ("V", (_HIDDEN, _GATE)), ("G", (_HIDDEN, _GATE)), ("u", (_GATE,)), ("c", (_HIDDEN,)))}
    m |= {"e": np.zeros(_HIDDEN), "d": np.zeros(1), "mean": every.mean(0), "std": every.std(0) + 0.02}
    names = ("E", "e", "V", "G", "u", "c", "d")
    first, second, k = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            pick = order[at : at + batch]
            doc = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            r = forward(m, np.concatenate([bags[i] for i in pick]), doc)
            dp = (r["p"] - y[pick]) / len(pick)
            dz = dp[:, None] * m["c"]
            da = (dz[doc] * r["h"]).sum(1)
            de = r["a"] * (da - np.add.reduceat(r["a"] * da, r["starts"])[doc])
            dt, dg = de[:, None] * m["u"] * r["g"] * (1 - r["t"] ** 2), de[:, None] * m["u"] * r["t"] * r["g"] * (1 - r["g"])
            dh = (r["a"][:, None] * dz[doc] + dt @ m["V"].T + dg @ m["G"].T) * (1 - r["h"] ** 2)
            grad = {"c": r["z"].T @ dp, "d": dp.sum(keepdims=True), "u": (r["t"] * r["g"]).T @ de, "V": r["h"].T @ dt, "G": r["h"].T @ dg, "E": r["x"].T @ dh, "e": dh.sum(0)}
            k += 1
            for n in names:
                g = grad[n] + 1e-4 * m[n]
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
                m[n] = m[n] - rate * first[n] / (1 - 0.9**k) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)
    return m


def score(model: dict | float, texts: list[bytes]) -> list[float]:
    """Scores of whole texts, some megabytes at a time."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
            size += len(texts[end])
            end += 1
        if isinstance(model, float):
            out += [model] * (end - at)
        else:
            x, doc = passages(texts[at:end])
            out += forward(model, x, doc)["p"].tolist()
        at = end
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept apart from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> dict | float:
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).join(F.broadcast(sample), "doc_id")  # at most train_docs ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("t").alias("t"))  # and as many rows: the least text of a repeated doc_id

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bags = [passages([bytes(t)])[0].tobytes() for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "bag": bags})

    got = sorted(rows.mapInPandas(run, "doc_id long, y int, bag binary").collect(), key=lambda r: (r["doc_id"], r["bag"]))
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in got], np.array([float(r["y"] > 0) for r in got]))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    model = train(docs, labels, text)

    def run(texts: list[bytes]) -> list[list]:
        p = score(model, texts)
        return [p, [int(x >= cut) for x in p]]

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return add_columns(rows, ["doc_id", "held_out"], ["t"], run, {"score": "double", "predicted": "int"})
