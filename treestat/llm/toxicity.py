"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

A text's features are its distinct lower-case words and their beginnings of 4 and 5 letters, hashed. One weight vector
is shared by all ordered thresholds: P(grade > k) = sigmoid(x.w - threshold_k). The output is the expected severity,
the sum of these probabilities, and the decision P(grade > 0) >= ``CUT``.

Labels say toxic or not. Grades are made from them on the training sample: 0 is not toxic; toxic documents have grade 1
to 3 by the terciles of the number of distinct toxic features among their distinct words. Features are kept if their
document frequencies in the two classes differ by ``Z`` standard errors and their log-odds by ``ODDS``. The model is fitted on at most ``TRAIN_DOCS``
labelled documents (those with the smallest hash of doc_id; the least text of a repeated doc_id); every other step covers every document and whole texts.

Defined cases: NULL or empty text has no features and gets the prior. Labels that are NULL are skipped; several labels
of one doc_id count as toxic if one says so. Without a toxic and a clean label every document has severity 0.
Repeated rows give repeated rows. Other columns, also such with clashing names, are not looked at by ``severity`` and
kept as they are by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.llm.tables import add_columns, held, keep_rows, release
from treestat.session import written

TRAIN_DOCS = 15_000
BITS = 20
Z = 3.0
ODDS = 2.5
GRADES = 3
CUT = 0.5
MEMO_WORDS = 250_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    mask = (1 << BITS) - 1
    kinds = ["w" + word, *(f"{k}{word[:k]}" for k in (4, 5) if len(word) > k)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in kinds)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Shared weights of the kept features and the ordered thresholds."""

    weight: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [50.0] * GRADES)

    def present(self, text: str) -> set[int]:
        """Kept features of a text."""
        memo, found = held(("toxicity", len(self.weight), *self.thresholds), dict), set()
        for w in words_of(text):
            if (hits := memo.get(w)) is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                hits = memo[w] = tuple(f for f in features(w) if f in self.weight)
            if hits:
                found.update(hits)
        return found

    def above(self, text: str) -> list[float]:
        """P(grade > 0), P(grade > 1), ..."""
        s = sum(self.weight[f] for f in sorted(self.present(text)))
        return [1 / (1 + np.exp(min(60.0, max(-60.0, t - s)))) for t in self.thresholds]


def _telling(df0: np.ndarray, df1: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of features with these document frequencies: whether they are kept, whether they speak for toxic, their log-odds."""
    p = (df1 + df0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (df1 / n1 - df0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        odds = np.log(((df1 + 0.1) / (n1 + 0.2)) / ((df0 + 0.1) / (n0 + 0.2)))
    return (np.abs(np.nan_to_num(z)) > Z) & (np.abs(odds) > ODDS), z > 0, odds


def fit(lists: list[np.ndarray], toxic: np.ndarray, **how) -> Model:
    """Fit on hashed feature lists (distinct per document) and 0/1 labels."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model()
    at = np.repeat(toxic, [len(x) for x in lists])
    feat = np.concatenate(lists)
    df1, df0 = (np.bincount(feat[at == side].astype(np.int64), minlength=1 << BITS) for side in (1, 0))
    kept, bad, odds = _telling(df0, df1, n0, n1)
    kept = np.flatnonzero(kept)
    return _fit(kept, bad[kept], odds[kept], [_places(kept, x) for x in lists], np.array([len(x) for x in lists]), toxic, **how)


def _places(kept: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where those of a text's features that are kept stand in the sorted ``kept``."""
    features = np.asarray(features, np.int64)
    place = np.searchsorted(kept, features)
    place[place == len(kept)] = 0
    return place[kept[place] == features] if len(kept) else place[:0]


def _fit(kept: np.ndarray, bad: np.ndarray, odds: np.ndarray, places: list[np.ndarray], sizes: np.ndarray, toxic: np.ndarray, rounds: int = 400, rate: float = 0.01, l2: float = 1e-5) -> Model:
    """Fit on the kept features (their places in ``kept``) of each document, its number of all features, and 0/1 labels."""
    doc = np.repeat(np.arange(len(places), dtype=np.int32), [len(x) for x in places])
    feat = np.concatenate(places).astype(np.int64)
    strength = np.bincount(doc, bad.astype(float)[feat], len(places)) / np.maximum(1, sizes)
    cuts = np.quantile(strength[toxic == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, strength, side="right"), 0)

    # start from half the smoothed log-odds of each feature alone, so that rare plain signs weigh at once
    w = 0.5 * odds
    theta, gaps = 1.0, np.zeros(GRADES - 1)
    moments = [np.zeros(len(kept) + GRADES) for _ in range(2)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for k in range(1, rounds + 1):
        cut = np.concatenate([[-np.inf], theta + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
        s = np.bincount(doc, w[feat], len(places))
        hi, lo = sigmoid(cut[grade + 1] - s), sigmoid(cut[grade] - s)
        prob = np.maximum(hi - lo, 1e-12)
        f_hi, f_lo = hi * (1 - hi), lo * (1 - lo)
        ds = (f_hi - f_lo) / prob / len(places)
        g_cut = np.bincount(grade + 1, -f_hi / prob, GRADES + 2) + np.bincount(grade, f_lo / prob, GRADES + 2)
        g_cut = g_cut[1 : GRADES + 1] / len(places)
        g_gap = np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(gaps)
        grad = np.concatenate([np.bincount(feat, ds[doc], len(kept)) + l2 * w, [g_cut.sum()], g_gap])
        moments[0] += 0.1 * (grad - moments[0])
        moments[1] += 0.001 * (grad**2 - moments[1])
        step = rate * moments[0] / (1 - 0.9**k) / (np.sqrt(moments[1] / (1 - 0.999**k)) + 1e-8)
        w, theta, gaps = w - step[: len(kept)], theta - step[len(kept)], gaps - step[len(kept) + 1 :]
    cut = theta + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return Model(dict(zip(kept.tolist(), w.tolist())), cut.tolist())


def train(docs: DataFrame, labels: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of labelled documents.

    Document frequencies are counted and features chosen by tasks; the driver gets the kept features and their places
    in each document of the sample, not the sample's features.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "doc_id")  # at most train_docs ids
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))  # and as many rows, one for each id

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in frames:
            lists = [sorted({f for w in words_of(t) for f in features(w)}) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": (pdf["toxic"] > 0).astype(int), "f": [np.asarray(x, "<i4").tobytes() for x in lists]})

    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "t").mapInPandas(run, "doc_id long, toxic int, f binary")
    rows = written(rows, "toxic-features")
    number = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = number.get(0, 0), number.get(1, 0)
    if not n1 or not n0:
        return Model()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros((2, 1 << BITS), np.int64)
        for pdf in frames:
            for side in (0, 1):
                got = np.frombuffer(b"".join(pdf.loc[pdf["toxic"] == side, "f"]), "<i4")
                total[side] += np.bincount(got, minlength=1 << BITS)
        some = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"feature": some, "df0": total[0, some], "df1": total[1, some]})

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            kept, bad, odds = _telling(pdf["df0"].to_numpy(), pdf["df1"].to_numpy(), n0, n1)
            yield pd.DataFrame({"feature": pdf["feature"], "bad": bad, "odds": odds})[kept]

    seen = rows.select("toxic", "f").mapInPandas(count, "feature long, df0 long, df1 long").groupBy("feature").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1"))
    kept = seen.mapInPandas(choose, "feature long, bad boolean, odds double").toPandas().sort_values("feature")
    feature = kept["feature"].to_numpy(np.int64)

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lists = [np.frombuffer(x, "<i4") for x in pdf["f"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "size": [len(x) for x in lists], "places": [_places(feature, x).astype("<i4").tobytes() for x in lists]})

    got = rows.mapInPandas(narrow, "doc_id long, toxic int, size int, places binary").collect()
    got.sort(key=lambda r: r["doc_id"])  # the same model whatever the order of the tasks
    places = [np.frombuffer(r["places"], "<i4") for r in got]
    return _fit(feature, kept["bad"].to_numpy(bool), kept["odds"].to_numpy(float), places, np.array([r["size"] for r in got]), np.array([r["toxic"] for r in got]))


def severity(docs: DataFrame, labels: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, expected severity (0 to 3), most probable grade, p_toxic, toxic."""
    model = train(docs, labels, text)

    def score(texts: list[str]) -> list[list]:
        a = np.array([model.above(t) for t in texts]).reshape(len(texts), GRADES)
        shares = np.hstack([np.ones((len(a), 1)), a]) - np.hstack([a, np.zeros((len(a), 1))])
        return [a.sum(1).tolist(), shares.argmax(1).tolist(), a[:, 0].tolist(), (a[:, 0] >= cut).tolist()]

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    return add_columns(rows, ["doc_id"], ["t"], score, {"severity": "double", "grade": "int", "p_toxic": "double", "toxic": "boolean"})


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the documents that are toxic."""
    model = train(docs, labels, text)
    return keep_rows(docs, text, lambda texts: [bool(model.above(t)[0] < cut) for t in texts])
