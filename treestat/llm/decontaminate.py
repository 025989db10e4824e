"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Every window of a document that has as many words as a benchmark item is compared with that item. A window's 64-bit
SimHash is taken over its five-word shingles, weighted by their counts. The item fingerprints lie in an index of four
16-bit blocks; two fingerprints within ``RADIUS`` bits differ by at most RADIUS // 4 bits in one block, so looking up
the blocks' neighbourhoods finds every fingerprint within the radius. What is found is verified by the exact weighted
Jaccard similarity of the shingles, ``SIMILARITY`` or more. A window that shares no shingle with any item has
similarity 0 and is not fingerprinted.

A benchmark of up to ``GROUP_ITEMS`` items and ``GROUP_CHARS`` characters is one index, which every task holds. A larger one
stays in tables, and neither the driver nor a task holds it. The shingles of all items make a filter, and one pass over
the documents writes the zones whose shingles are in the filter so densely that a window of similarity ``least`` may lie
there. Zones and items meet by a join on shingles: a window of similarity ``least`` lacks so few of an item's shingles that it
has one of any few of them (``prefix``), and the rarest among items are taken. Each document's items, some at a time, are then
an index of their own, which its zones are searched with. No step loses a window. Defined cases: NULL or empty texts and items without words match nothing. A document shorter than an
item is one window. An item of fewer than five words is a single shingle of its own length, which only a document with
as many words can have. Repeated items are separate items; repeated rows give repeated rows. Other columns, also such with
clashing names, are not looked at by ``leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treestat.llm.shingles import WORDS, shingles, slices, words
from treestat.llm.tables import add_columns, held, keep_rows
from treestat.session import written

SIMILARITY = 0.8
RADIUS = 18
_BLOCKS, _BITS = 4, 16
#: Items and characters of items in one group.
GROUP_ITEMS, GROUP_CHARS = 1000, 8_000_000
#: Bits of the filter of item shingles: 8 MB, or up to 64 MB for many items. Where even those are mostly set, zones grow
#: and the join does the work.
FILTER_BITS, MOST_BITS = 26, 29
#: Items that one index of a document's own holds.
AT_ONCE = 200
_ZONES = "array<struct<first:bigint,shingles:binary>>"


def _masks(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(_BITS), r)], np.int64)


def running_bits(sh: np.ndarray) -> np.ndarray:
    """For each of 64 bits, how many of the first k shingles have it set."""
    bits = np.unpackbits(sh.view(np.uint8).reshape(-1, 8), axis=1)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])


def window_prints(total: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every run of ``n`` neighbouring shingles, from their running bits; counts are the weights."""
    return np.packbits(2 * (total[n:] - total[:-n]) > n, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of benchmark items, searchable by Hamming distance."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS) -> None:
        self.radius = radius
        hashes, bounds = words([t for _, t in items])
        sh, at = shingles(hashes, bounds)
        lens = np.diff(bounds)
        use = [k for k in range(len(items)) if lens[k]]
        self.ids = [items[k][0] for k in use]
        self.lens = lens[use]
        self.sh = [sh[at[k] : at[k + 1]] for k in use]
        self.prints = np.array([window_prints(running_bits(s), len(s))[0] for s in self.sh], np.uint64)
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in self.sh]
        self.known = np.unique(sh)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.known >> np.uint64(42)] = True
        masks = _masks(radius // _BLOCKS)
        self.tables = []
        for b in range(_BLOCKS):
            keys = ((self.prints >> np.uint64(_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ masks
            order = np.argsort(keys, axis=None, kind="stable")
            starts = np.searchsorted(keys.ravel()[order], np.arange((1 << _BITS) + 1))
            self.tables.append(((order // len(masks)).astype(np.int32), starts))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``prints``, item) within the radius."""
        found = []
        for b, (items, starts) in enumerate(self.tables):
            key = ((prints >> np.uint64(_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = starts[key + 1] - starts[key]
            place = np.repeat(np.arange(len(prints)), n)
            offset = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            item = items[np.repeat(starts[key], n) + offset]
            ok = np.bitwise_count(prints[place] ^ self.prints[item]) <= self.radius
            found.append(place[ok].astype(np.int64) * len(self.ids) + item[ok])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def screened(self, sh: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        hit = np.flatnonzero(self.seen[sh >> np.uint64(42)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.known, sh[hit]), len(self.known) - 1)
            hit = hit[self.known[at] == sh[hit]]
        return hit

    def similarity(self, window: np.ndarray, i: int) -> float:
        """Weighted Jaccard similarity of a window and an item."""
        left, least = dict(self.counts[i]), 0
        for x in window.tolist():
            if n := left.get(x):
                left[x] = n - 1
                least += 1
        return least / (len(window) + len(self.sh[i]) - least)

    def search(self, sh: np.ndarray, hit: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word) of its best window in one document; ``hit`` are the places shared with items."""
        best: dict[int, tuple[float, int]] = {}
        longest = int(self.lens.max())
        # runs of windows that hold a hit, so long texts are fingerprinted only there
        cut = np.flatnonzero(np.diff(hit) > longest)
        for a, b in zip(hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]):
            lo, hi = max(0, a - longest), min(len(sh), b + longest + 1)
            part = sh[lo:hi]
            total, prints, firsts, runs = running_bits(part), [], [], []
            for size in np.unique(self.lens).tolist():
                n = min(max(1, size - WORDS + 1), len(sh))
                if n <= len(part):
                    prints.append(window_prints(total, n))
                    firsts.append(np.arange(len(prints[-1])))
                    runs.append(np.full(len(prints[-1]), (size << 32) + n))
            if not prints:
                continue
            first, run = np.concatenate(firsts), np.concatenate(runs)
            place, item = self.near(np.concatenate(prints))
            same = self.lens[item] == run[place] >> 32
            for p, n, i in zip(first[place[same]].tolist(), (run[place[same]] & 0xFFFFFFFF).tolist(), item[same].tolist()):
                s = self.similarity(part[p : p + n], i)
                if s >= least and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (s, lo + p)
        return best

    def documents(self, texts: list[str], least: float) -> Iterator[dict[int, tuple[float, int]]]:
        if not len(self.ids):
            yield from ({} for _ in texts)
            return
        for a, b in slices(texts):
            sh, at = shingles(*words(texts[a:b]))
            hit = self.screened(sh)
            cuts = np.searchsorted(hit, at)
            for k in range(b - a):
                h = hit[cuts[k] : cuts[k + 1]] - at[k]
                yield self.search(sh[at[k] : at[k + 1]], h, least) if len(h) else {}


def _index(items: list[tuple[int, str]], radius: int) -> Index:
    """The worker's index of a group of items."""
    return held((radius, *items), lambda: Index(items, radius))


def _items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """Items with text, and whether they are so few that each task holds them."""
    b = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    n, chars = b.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return b, n <= GROUP_ITEMS and chars <= GROUP_CHARS


def _collected(b: DataFrame) -> list[tuple[int, str]]:
    """A benchmark of bounded size, in one order."""
    return sorted(((r["item_id"], r["text"]) for r in b.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def item_filter(b: DataFrame, most: int | None = None) -> tuple[np.ndarray, int, int]:
    """The filter of all item shingles (one bit for the first bits of each), and the least and greatest number of an item's shingles."""
    chars = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(most or MOST_BITS, max(FILTER_BITS, int(chars).bit_length() + 1))  # about 10 bits for a shingle

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sh, at = shingles(*words(pdf["text"].tolist()))
            n = np.diff(at)
            if len(sh):
                bit = np.unique(sh >> np.uint64(64 - bits)).astype(np.int64)
                yield pd.DataFrame({"bit": bit, "low": int(n[n > 0].min()), "high": int(n.max())})

    found = b.select("text").mapInPandas(run, "bit long, low long, high long")
    rows = found.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = rows.toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64), *((min(got["low"].to_pylist()), max(got["high"].to_pylist())) if len(got) else (1, 0))


def zones(sh: np.ndarray, bits: np.ndarray, low: int, high: int, least: float) -> list[tuple[int, int]]:
    """Ranges of shingles that hold every window with a share of at least ``least`` in the filter, for all sizes of items.

    A window of m to 2m shingles with that share has at least m - 2m(1 - least) hits among its first m.
    """
    if not len(sh) or not high:
        return []
    at = sh >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    hits = np.concatenate([[0], np.cumsum(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))]).astype(np.int64)
    wide, m = np.zeros(len(sh) + 1, np.int64), low
    while m <= high:
        n = min(m, len(sh))
        need = least * n if n == len(sh) else max(1.0, n - 2 * n * (1 - least))
        first = np.flatnonzero(hits[n:] - hits[:-n] >= need - 1e-9)
        np.add.at(wide, first, 1)
        np.add.at(wide, np.minimum(first + 2 * n, len(sh)), -1)
        if n == len(sh):
            break
        m *= 2
    edge = np.flatnonzero(np.diff(np.cumsum(wide)[:-1] > 0, prepend=False, append=False))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _zoned(docs: DataFrame, b: DataFrame, text: str, least: float) -> DataFrame:
    """rid (a number of the row), doc_id, k1, k2 (128 bits of hash of the text) and the zones of every document that has some."""
    bits, low, high = item_filter(b)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 8 to 64 MB

    def run(texts: list[str]) -> list[list]:
        out = []
        for a, e in slices(texts):
            sh, at = shingles(*words(texts[a:e]))
            for k in range(e - a):
                own = sh[at[k] : at[k + 1]]
                out.append([(x, own[x:y].tobytes()) for x, y in zones(own, shared.value, low, high, least)])
        return [out]

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).withColumns(_text_key("t"))
    found = add_columns(rows, ["doc_id", "k1", "k2"], ["t"], run, {"zones": _ZONES}).filter(F.size("zones") > 0)
    return written(found.withColumn("rid", F.monotonically_increasing_id()), "zones")


def prefix(n: int, least: float) -> int:
    """Of so many of an item's ``n`` shingles any window of similarity ``least`` and of no more shingles has one at least."""
    # common / (n + m - common) >= least with common <= m asks for common >= least n, also of a window shorter than the item
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def _keyed(b: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Different item texts (iid, text), and the shingles (s, iid) by which each is found: its rarest among items."""
    texts = written(b.groupBy("text").agg(F.count("*").alias("same")).withColumn("iid", F.monotonically_increasing_id()).select("iid", "text"), "items")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sh, at = shingles(*words(pdf["text"].tolist()))
            for k, i in enumerate(pdf["iid"]):
                own, count = np.unique(sh[at[k] : at[k + 1]], return_counts=True)
                yield pd.DataFrame({"iid": i, "s": own.view(np.int64), "c": count, "need": prefix(int(count.sum()), least)})

    each = texts.mapInPandas(run, "iid long, s long, c long, need long")
    often = each.groupBy("s").agg(F.count("*").alias("items"))
    rare = Window.partitionBy("iid").orderBy("items", "s")
    # counted shingles before this one: as many as are needed, a repeated one with its count
    ranked = each.join(often, "s").withColumn("before", F.sum("c").over(rare) - F.col("c"))
    return texts, ranked.filter("before < need").select("s", "iid")


def _met(found: DataFrame, b: DataFrame, radius: int, least: float) -> tuple[DataFrame, DataFrame]:
    """rid and leaks (by iid) of the best window of every item in the zones of ``found``, and the items' texts by iid."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for rid, zs in zip(pdf["rid"], pdf["zones"]):
                own = np.unique(np.concatenate([np.frombuffer(z["shingles"], np.int64) for z in zs]))
                yield pd.DataFrame({"rid": rid, "s": own})

    texts, keys = _keyed(b, least)
    pairs = found.select("rid", "zones").mapInPandas(spread, "rid long, s long").join(keys, "s").select("rid", "iid").distinct()
    numbered = pairs.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("rid").orderBy("iid")) - 1) / AT_ONCE))
    lists = numbered.join(texts, "iid").groupBy("rid", "part").agg(F.sort_array(F.collect_list(F.struct("iid", "text"))).alias("items"))
    return add_columns(lists.join(found.select("rid", "zones"), "rid"), ["rid"], ["items", "zones"], partial(_in_zones, radius, least), _LEAKS), texts


def _text_key(text: Column | str) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)}


def _in_zones(radius: int, least: float, lists: list, zoned: list) -> list[list]:
    out = []
    for items, found in zip(lists, zoned):
        index, best = Index([(i["iid"], i["text"]) for i in items], radius), {}
        for z in found if index.ids else []:
            sh = np.frombuffer(z["shingles"], np.uint64)
            if len(hit := index.screened(sh)):
                for i, (s, p) in index.search(sh, hit, least).items():
                    if s > best.get(i, (0.0, 0))[0]:
                        best[i] = (s, z["first"] + p)
        out.append(_leak_rows(index, best))
    return [out]


def _in_texts(items: list[tuple[int, str]], radius: int, least: float, texts: list[str]) -> list[list]:
    index = _index(items, radius)
    return [[_leak_rows(index, found) for found in index.documents(texts, least)]]


def _leak_rows(index: Index, found: dict[int, tuple[float, int]]) -> list[tuple]:
    return [(index.ids[i], s, p, int(index.lens[i])) for i, (s, p) in sorted(found.items())]


_LEAKS = {"leak": "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"}


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every item in every document that leaks it."""
    b, few = _items(benchmark)
    if few:
        rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
        made = add_columns(rows, ["doc_id"], ["t"], partial(_in_texts, _collected(b), radius, least), _LEAKS)
        return made.select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")
    found = _zoned(docs, b, text, least)
    met, texts = _met(found, b, radius, least)
    best = met.select("rid", F.explode("leak").alias("leak")).select("rid", F.col("leak.item_id").alias("iid"), "leak.similarity", "leak.first_word", "leak.n_words")
    ids = b.join(texts, "text").select("iid", "item_id")  # repeated texts are items of their own
    return found.select("rid", "doc_id").join(best, "rid").join(ids, "iid").select("doc_id", "item_id", "similarity", "first_word", "n_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    b, few = _items(benchmark)
    if few:
        items = _collected(b)
        return keep_rows(docs, text, lambda texts: [not found for found in _index(items, radius).documents(texts, least)])
    found = _zoned(docs, b, text, least)
    met, _ = _met(found, b, radius, least)
    dirty = written(met.filter(F.size("leak") > 0).select("rid").join(found.select("rid", "k1", "k2"), "rid").select("k1", "k2").distinct(), "leaks")
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(k) for k, c in _text_key(t).items()))
    return keyed.join(dirty, ["k1", "k2"], "left_anti").select("row.*")
