"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded joins, exact verification.

A text is a weighted set: its five-word shingles with their counts. Darts fall on the plane of each shingle (weight by
rank) at hashed places, one per unit of area on average. A text keeps the darts below its weights and below a rank
bound that leaves some k ln k of them; each dart has one of ``k`` coordinates, and the earliest dart of a coordinate is
the signature's entry. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts that agree in all rows of a band are candidates. Equal texts are one node from the start. In each bucket all
members are first compared with the least one. What is left in a bucket of several components are outsiders, members
that are not in its main component: they are compared, block by block, with all members of other components, first with
those whose signatures agree most and at last with every one but for those that cannot be similar. (Shingles are dealt
into ``CELLS`` cells by hash, and the sum of the lesser counts of the cells is never less than the sum of the lesser
counts of the shingles.) A bucket in which more than ``CROWD`` pairs would be compared is first cut up: two similar texts
share one of the rarest shingles of each, so only members that share one of those are compared. Strangers that share a
passage, and large groups that only share a passage, part there. So a group of copies costs a few comparisons per member, no pair of its members is listed, and
a few strangers in its bucket are compared with it, not its members with one another. Similarity ``least`` or more (sum of least over sum of greatest counts, computed from the whole
texts) is a link, and components of links are the groups.

Defined cases: NULL texts and texts without words are alone. A text with fewer than five words is one shingle. Rows of
one doc_id are one document. Rows without doc_id are in no group. Other columns, also such with clashing names, are not
looked at by ``groups`` and kept by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.llm.graph import components
from treestat.llm.shingles import mix, shingles, slices, weighted_jaccard, words
from treestat.llm.tables import by_group, release
from treestat.session import written

SIMILARITY = 0.8
#: Texts of similarity 0.8 share a band with probability 0.996, of 0.5 with 0.17, of 0.3 with 0.005.
BANDS, ROWS = 24, 7
AGREE_FIRST = 0.65
#: Cells of shingle counts that bound a similarity from above.
CELLS = 256
#: Pairs of a bucket compared before it is cut up by rare shingles, and the cells whose counts say how rare a shingle is.
CROWD, RARITY_CELLS = 1 << 24, 1 << 18
#: Members of a bucket compared at once, and partners that a member outside the main component tries first.
BLOCK, TRIES = 512, 4
_COUNT, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)


@lru_cache(None)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative distribution of the number of darts in an area."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])))


def _cell(q: int, first: float) -> tuple[float, float]:
    """Interval q of a line: [0, first), then doubling."""
    return (0.0, first) if q == 0 else (first * 2 ** (q - 1), first * 2**q)


def _fraction(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _thrown(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """All darts below the weights and the rank bounds: document, coordinate, rank, dart."""
    out = []
    top_w, top_r = float(weight.max()), float(bound.max())
    v = 0
    while (low := _cell(v, 1.0))[0] < top_w:
        heavy = np.flatnonzero(weight > low[0])
        hv, dv, wv = h[heavy], doc[heavy], weight[heavy]
        q = 0
        while (cell := _cell(q, 1 / 64))[0] < top_r:
            on = np.flatnonzero(bound[dv] > cell[0])
            base = mix(hv[on] + np.uint64((q * 1_000_003 + v + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            area = (low[1] - low[0]) * (cell[1] - cell[0])
            n = np.searchsorted(_poisson(area), _fraction(base), side="right")
            hit = np.flatnonzero(n)
            n = n[hit]
            number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(np.repeat(base[hit], n) + (number.astype(np.uint64) + np.uint64(1)) * _COUNT)
            d, w = np.repeat(dv[on[hit]], n), np.repeat(wv[on[hit]], n)
            rank = cell[0] + (cell[1] - cell[0]) * ((dart & _LOW).astype(np.float64) * 2.0**-32)  # low bits: rank, high bits: coordinate
            keep = rank < bound[d]
            if v:  # the first strip holds whole weights only
                keep &= low[0] + (low[1] - low[0]) * _fraction(mix(dart - _COUNT)) < w
            dart, d, rank = dart[keep], d[keep], rank[keep]
            out.append((d, ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), rank, dart))
            q += 1
        v += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(sh: np.ndarray, bounds: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k signature entries of every non-empty multiset; zeros for empty ones."""
    sizes = np.diff(bounds)
    sig = np.zeros((len(sizes), k), np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])])) if len(sh) else np.empty(0, np.int64)
    weight = np.diff(np.append(first, len(sh)))
    h, doc = sh[first], doc[first]
    todo, darts = np.flatnonzero(sizes), k * (math.log(k) + 2.5)
    while len(todo):
        bound = np.zeros(len(sizes))
        bound[todo] = darts / sizes[todo]
        use = bound[doc] > 0
        d, c, rank, dart = _thrown(h[use], doc[use], weight[use], bound, k)
        key = d * k + c
        best = np.full(len(sizes) * k, np.inf)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        sig.reshape(-1)[key[won]] = dart[won]
        full = np.isfinite(best)
        todo = todo[~full.reshape(-1, k)[todo].all(1)]
        darts *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band."""
    part = sig.reshape(len(sig), bands, -1)
    key = np.zeros(part.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(part.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, class (a digest of the text), and band keys of texts with words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in frames:
            texts = pdf["t"].tolist()
            for a, b in slices(texts, 1_000_000, 500):  # each text throws k ln k darts, however short
                sh, at = shingles(*words(texts[a:b]))
                sig = signatures(sh, at)
                keys = band_keys(sig)
                some = np.diff(at) > 0
                sketch = [np.concatenate([x.view(np.uint8), y]).tobytes() for x, y in zip(keys, sig.astype(np.uint8))]
                cut = pdf[["doc_id", "cls"]].iloc[a:b]
                yield cut.assign(bands=[x if s else None for x, s in zip(keys, some)], sketch=sketch)

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("cls"), "t").mapInPandas(run, "doc_id long, cls string, bands array<long>, sketch binary")


def cells(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of every multiset's shingles by cell."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    return np.bincount(doc * CELLS + (sh >> np.uint64(32)).astype(np.int64) % CELLS, minlength=n * CELLS).reshape(n, CELLS).astype(np.int32)


def _counted(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """``mixed`` with cells of shingle counts in place of signatures behind the band keys of the sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in frames:
            ts = pdf["t"].tolist()
            for a, b in slices(ts, 1_000_000, 500):
                yield pd.DataFrame({"rep": pdf["doc_id"].iloc[a:b], "cells": [x.tobytes() for x in cells(*shingles(*words(ts[a:b])))]})

    some = texts.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "t")
    counts = written(some.mapInPandas(run, "rep long, cells binary").distinct(), "cells")
    return mixed.join(counts, "rep").withColumn("sketch", F.concat(F.substring("sketch", 1, BANDS * 8), "cells")).drop("cells")


def _prefixes(sh: np.ndarray, bounds: np.ndarray, rarity: np.ndarray, least: float) -> list[np.ndarray]:
    """The rarest shingles of every text, each occurrence one of its own: so many that texts of similarity ``least`` share one.

    All texts put occurrences in one order (by the count of their cell, then by hash). A text of n occurrences shares
    at least ``least`` n with a similar one, so the first of the shared ones stands among its first n - ceil(least n) + 1.
    """
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((sh, doc))
    sh = sh[order]
    new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])]) if len(sh) else np.empty(0, bool)
    first = np.flatnonzero(new)
    number = np.arange(len(sh)) - np.repeat(first, np.diff(np.append(first, len(sh))))  # doc is in order already
    token = np.where(number > 0, mix(sh + number.astype(np.uint64) * _COUNT), sh)
    order = np.lexsort((token, rarity[(token % np.uint64(len(rarity))).astype(np.int64)], doc))
    token = token[order].view(np.int64)
    size = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
    return [token[a : a + k] for a, k in zip(bounds[:-1], np.minimum(size, n))]


def _tokens(texts: DataFrame, rarity: np.ndarray, least: float) -> DataFrame:
    """rep, tokens: ``_prefixes`` of the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in frames:
            ts = pdf["t"].tolist()
            for a, b in slices(ts, 1_000_000, 500):
                yield pd.DataFrame({"rep": pdf["doc_id"].iloc[a:b], "tokens": _prefixes(*shingles(*words(ts[a:b])), rarity, least)})

    return texts.select("doc_id", "t").mapInPandas(run, "rep long, tokens array<long>")


def _rarity(texts: DataFrame) -> np.ndarray:
    """Occurrences of shingles by cell: a table of ``RARITY_CELLS`` numbers, whatever the number of texts."""
    cells = RARITY_CELLS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros(cells, np.int64)
        for pdf in frames:
            ts = pdf["t"].tolist()
            for a, b in slices(ts, 1_000_000, 500):
                total += np.bincount((shingles(*words(ts[a:b]))[0] % np.uint64(cells)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"cell": some, "n": total[some]})

    got = texts.select("t").mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _cut_up(mixed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``mixed`` with every crowded bucket replaced by the smaller ones of its members that share a rare shingle.

    No link is lost: two similar members of a bucket share a rare shingle, so they meet in one of the smaller ones.
    """
    crowded = F.col("n") * F.col("outside") > CROWD
    crowd = mixed.filter(crowded)
    if crowd.isEmpty():
        return mixed
    some = written(texts.join(crowd.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "crowd")
    tokens = _tokens(some, _rarity(some), least)
    rows = crowd.join(tokens, "rep").select("band", "rep", "root", "main", F.explode("tokens").alias("token"), "key")
    rows = written(rows.select(F.xxhash64("key", "token").alias("key"), "band", "rep", "root", "main"), "cut-up")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("outside"), F.min("root").alias("a"), F.max("root").alias("b"))
    smaller = rows.join(sizes.filter("a <> b").select("key", "n", "outside").hint("merge"), "key")
    return mixed.filter(~crowded).unionByName(smaller)


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """key, band, rep, root of the members of buckets with several components; main: the component with most members,
    outside: members of others, n: all members."""
    now = buckets.join(found.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").select("key", "band", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    order = F.max_by("root", F.struct("n", -F.col("root")))
    info = sizes.groupBy("key").agg(F.count("*").alias("roots"), order.alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("roots > 1")
    return now.join(info.select("key", "main", "n", (F.col("n") - F.col("most")).alias("outside")).hint("merge"), "key")


def _agreeing(mixed: DataFrame, tries: int | None, least: float) -> DataFrame:
    """Pairs (a, b) of an outsider and a member of another component in one bucket: with agreeing signatures, the
    ``tries`` best of each outsider in a block; without ``tries``, all whose cells of counts allow a similarity of
    ``least``. Blocks of outsiders meet blocks of all members."""
    at = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(n) / BLOCK) - 1))
    left = mixed.filter("root <> main").withColumn("i", at("outside")).withColumn("j", each("n"))
    right = mixed.withColumn("j", at("n")).withColumn("i", each("outside"))
    rows = left.withColumn("side", F.lit(True)).unionByName(right.withColumn("side", F.lit(False)))
    rows = rows.select("rep", "root", "main", "band", "sketch", "side", F.xxhash64("key", "i", "j").alias("g"))

    def pairs(rep, root, main, band, keys, sig, left: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, 24_000_000 // max(1, len(right) * sig.shape[1]))
        for part in (left[k : k + step] for k in range(0, len(left), step)):
            ok = root[part][:, None] != root[right]
            if tries is None:  # each pair once: in the first band that it shares, and from one side
                both = np.minimum(sig[part][:, None], sig[right]).sum(2)
                total = sig[part].sum(1)[:, None] + sig[right].sum(1)
                ok &= both >= least * (total - both) * (1 - 1e-9)
                ok &= (keys[part][:, None] == keys[right]).argmax(2) == band[part][:, None]
                ok &= (root[right] == main[right]) | (rep[part][:, None] < rep[right])
            else:
                share = (sig[part][:, None] == sig[right]).mean(2)
                ok &= share >= AGREE_FIRST
                worst = -np.sort(-np.where(ok, share, -1), axis=1)[:, : tries][:, -1:]
                ok &= share >= worst
            a, b = np.nonzero(ok)
            a, b = rep[part[a]], rep[right[b]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, rep, root, main, band, side = (pdf[c].to_numpy() for c in ("g", "rep", "root", "main", "band", "side"))
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        keys, sig = np.ascontiguousarray(sketch[:, : BANDS * 8]).view(np.int64), sketch[:, BANDS * 8 :]
        if tries is None:
            sig = np.ascontiguousarray(sig).view(np.int32)
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for a, b in zip(start, np.append(start[1:], len(g))):
            left, right = np.flatnonzero(side[a:b]) + a, np.flatnonzero(~side[a:b]) + a
            yield from pairs(rep, root, main, band, keys, sig, left, right)

    return by_group(rows, "g", run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Long groups of one ``a`` are split by the join, not gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        last, left = None, None
        for pdf in frames:
            ok = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"]):
                if last != (a, ta):
                    last, left = (a, ta), shingles(*words([ta]))[0]
                ok.append(weighted_jaccard(left, shingles(*words([tb]))[0]) >= least)
            yield pdf.loc[ok, ["a", "b"]]

    b = texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta"))
    return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "ta", "b", "tb").mapInPandas(run, "a long, b long")


def groups(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id with the same text), group_id (least doc_id of its group), kept: one row per row with doc_id."""
    signed = written(_signed(docs, text), "signed")
    with_words = signed.filter("bands IS NOT NULL")
    classes = with_words.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    spread = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first <> last")
    buckets = written(spread.join(shared.select("key", "first").hint("merge"), "key"), "buckets")  # only buckets of two texts or more
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = written(rows.join(buckets.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    star = buckets.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_verified(star, texts, least), "links")
    found = components(links)
    for tries in (TRIES, None):  # what the first members did not settle: members of different components in one bucket
        mixed = _cut_up(written(_mixed(buckets, found), "mixed"), texts, least).join(classes.select("rep", "sketch"), "rep")
        if tries is None:
            mixed = _counted(mixed, texts)
        more = written(_verified(_agreeing(mixed, tries, least), texts, least), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)

    member = signed.select("doc_id", "cls", "bands").join(classes.select("cls", "rep"), "cls", "left").select("doc_id", F.when(F.col("bands").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"))
    out = member.join(found.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), (F.coalesce("root", "class_id") == F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id; one row of each doc_id."""
    gone = groups(docs, text, least).filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return left.select(*docs.columns)
    again = written(again, "repeated")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
