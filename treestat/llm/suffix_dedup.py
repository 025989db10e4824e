"""Removal of byte strings that occur more than once, by external induced suffix sorting.

Every byte covered by a string of ``size`` bytes that also starts elsewhere (in any text, overlaps count, judged on the
input) is removed. The windows of ``size`` bytes of a text are dealt into shards by content: a window's key is the least
hash of the 64-byte strings in it, so equal windows have equal keys, and neighbouring windows of one key form a segment.
Segments whose key occurs once hold nothing repeated. Equal segments (128-bit digest and key) are counted before
anything is sorted: a segment with another copy is repeated as a whole, and one copy of each different segment stands
for all. The different segments are sorted shard by shard with the external induced sorter, and a window is repeated
where the common prefix with a neighbour in suffix order has ``size`` bytes.

A shard takes whole keys and closes at ``shard_bytes``. A key whose different segments have more bytes than that (a
passage that very many texts share in different surroundings) is split by content first: its windows are dealt by the
place of the key's string in the window, in ranges of ``WIDTHS`` places, and by the hash of the bytes that all windows
of a range have in common. Equal windows still meet, and the same steps are applied to the pieces, with narrower ranges
for keys that are still too large; a range of one place leaves equal windows only. So a task's memory is bounded by
twice ``shard_bytes`` times the sorter's 30 to 45 bytes a byte, however often a passage occurs. Queue tuples beyond
``QUEUE_BYTES`` wait on disk.

Texts go through two joins on their own key and never meet in one task. Defined cases: NULL texts are empty; texts shorter
than ``size`` bytes lose nothing; repeated rows repeat one another's strings; rows without doc_id take part like any
other. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.llm.induced import repeated
from treestat.llm.shingles import mix
from treestat.llm.tables import add_columns
from treestat.session import written

SIZE = 400
GRAM = 64
SHARD_BYTES = 3_000_000
#: Places in a range, for keys over ``SHARD_BYTES``: first, then for those that are still over it, ...
WIDTHS = (96, 24, 6, 1)
#: Bytes of queue tuples that the sorter keeps in memory.
QUEUE_BYTES = 8 << 20
_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _least(text: bytes, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of ``gram`` bytes at each place, and the least of them in each window."""
    h, k = _BYTE[np.frombuffer(text, np.uint8)], 1
    while k < gram:  # hashes of 1, 2, 4, ... bytes
        h = h[:-k] * np.uint64(pow(_STEP, k, 1 << 64)) + h[k:]
        k *= 2
    h = mix(h)
    width = size - gram + 1
    n = len(h) - width + 1
    grid = np.concatenate([h, np.full(-len(h) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    head, tail = np.minimum.accumulate(grid, 1).ravel(), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return h, np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def _gram(size: int) -> int:
    gram = GRAM
    while gram > max(1, size // 4):
        gram //= 2
    return gram


def segments(text: bytes, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first window, number of windows, key, whether the key's string comes twice here."""
    none = np.empty(0, np.int64)
    if len(text) < size:
        return none, none, none.view(np.uint64), none.astype(bool)
    h, least = _least(text, size, _gram(size))
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    key = least[first]
    seen = np.zeros(1 << 16, bool)
    seen[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = h[seen[(h & np.uint64(0xFFFF)).astype(np.int64)]]
    values, times = np.unique(at, return_counts=True)
    twice = times[np.searchsorted(values, key)] > 1
    return first, np.diff(np.append(first, len(least))), key, twice


def pieces(text: bytes, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose least string lies at one place of the text, and in one range of ``width`` places of the
    window; the key is a hash of the bytes that all windows of the range have in common. No run has equal windows."""
    none = np.empty(0, np.int64)
    if len(text) < size:
        return none, none, none.view(np.uint64), none.astype(bool)
    h, least = _least(text, size, _gram(size))
    at = np.empty(len(least), np.int64)
    for value in np.unique(least):
        windows, places = np.flatnonzero(least == value), np.flatnonzero(h == value)
        at[windows] = places[np.searchsorted(places, windows)]
    part = (at - np.arange(len(at))) // width
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    lo = at[first] - part[first] * width
    common = [xxhash.xxh64_intdigest(text[a : a + size + 1 - width], r) for a, r in zip(lo.tolist(), part[first].tolist())]
    return first, np.diff(np.append(first, len(at))), np.array(common, np.uint64), np.zeros(len(first), bool)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, raw, and rid, rid2: 128 bits of hash of doc_id and text. Equal rows have equal keys."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return rows.select("doc_id", F.xxhash64("doc_id", "raw").alias("rid"), F.xxhash64(F.lit("second"), "raw", "doc_id").alias("rid2"), "raw")


def _segments(rows: DataFrame, size: int, width: int | None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            doc, out = [], []
            for k, raw in enumerate(pdf["raw"]):
                raw = bytes(raw)
                first, n, key, twice = segments(raw, size) if width is None else pieces(raw, size, width)
                if len(first):
                    digest = b"".join([xxhash.xxh128_digest(raw[a : a + m + size - 1]) for a, m in zip(first.tolist(), n.tolist())])
                    doc.append(np.full(len(first), k))
                    out.append((first, n, key.view(np.int64), np.frombuffer(digest, np.int64).reshape(-1, 2), twice))
            if out:
                k = np.concatenate(doc)
                first, n, key, digest, twice = (np.concatenate(c) for c in zip(*out))
                yield pdf[["rid", "rid2"]].iloc[k].assign(first=first, n=n, key=key, d1=digest[:, 0], d2=digest[:, 1], twice=twice)

    return rows.select("rid", "rid2", "raw").mapInPandas(run, "rid long, rid2 long, first long, n long, key long, d1 long, d2 long, twice boolean")


def _with_texts(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Rows with their own lists; equal rows share them."""
    return rows.join(lists, ["rid", "rid2"], how)


def _cut_out(rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """key, d1, d2, n and the bytes of the chosen segments."""
    lists = chosen.groupBy("rid", "rid2").agg(F.collect_set(F.struct("first", "n", "key", "d1", "d2")).alias("cuts"))  # a text's own

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for raw, cuts in zip(pdf["raw"], pdf["cuts"]):
                out += [(c["key"], c["d1"], c["d2"], c["n"], raw[c["first"] : c["first"] + c["n"] + size - 1]) for c in cuts]
            yield pd.DataFrame(out, columns=["key", "d1", "d2", "n", "bytes"])

    return _with_texts(rows, lists, "inner").select("raw", "cuts").mapInPandas(run, "key long, d1 long, d2 long, n long, bytes binary")


def _runs(hit: np.ndarray) -> list[list[int]]:
    """[first, end) of every run of True."""
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    return edge.reshape(-1, 2).tolist()


def _sorted(cut: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """key, d1, d2, spans: runs of repeated windows of each segment, from the suffix order of its shard."""

    def shard(held: list[tuple]) -> pd.DataFrame:
        parts = [h[4] for h in held]
        lens = np.array([len(p) + 1 for p in parts])
        text = np.empty(int(lens.sum()) + 1, np.int16)
        text[:-1] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        text[:-1] += 2
        ends = np.cumsum(lens)
        text[ends - 1], text[-1] = 1, 0
        hit = repeated(text, size, QUEUE_BYTES)
        out = pd.DataFrame([h[:3] for h in held], columns=["key", "d1", "d2"])
        return out.assign(spans=[_runs(hit[e - x : e - x + h[3]]) for e, x, h in zip(ends.tolist(), lens.tolist(), held)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size_held = 0
        for pdf in frames:
            for row in zip(*(pdf[c].tolist() for c in ("key", "d1", "d2", "n", "bytes"))):
                if size_held > shard_bytes and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size_held = [], 0
                held.append(row)
                size_held += len(row[4])
        if held:
            yield shard(held)

    return cut.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key long, d1 long, d2 long, spans array<array<long>>")


_SEGMENT = ["key", "d1", "d2"]


def _repeated(rows: DataFrame, size: int, shard_bytes: int, width: int | None, finer: tuple[int, ...]) -> DataFrame:
    """rid, rid2, start, end: runs of windows of ``raw`` that also start elsewhere. ``finer``: widths for hot keys."""
    found = written(_segments(rows, size, width), "segments")
    keys = found.groupBy("key").agg(F.count("*").alias("times"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)), F.max("twice").alias("twice"))
    keys = keys.filter("times > 1 OR twice").withColumn("equal", F.expr("times > 1 AND min_d1 = max_d1 AND min_d2 = max_d2"))
    some = written(found.drop("twice").join(keys.select("key", "equal"), "key"), "repeated")
    out = some.filter("equal").select("rid", "rid2", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end"))
    mixed = some.filter("NOT equal")
    one = written(mixed.groupBy(*_SEGMENT).agg(F.count("*").alias("copies"), F.min(F.struct("rid", "rid2", "first", "n")).alias("s")), "different")
    chosen = one.select(*_SEGMENT, "s.rid", "s.rid2", "s.first", "s.n")
    hot = chosen.groupBy("key").agg(F.sum(F.col("n") + size - 1).alias("bytes")).filter(F.col("bytes") > shard_bytes).select("key")
    hot = written(hot, "hot") if finer else None
    if hot is None or hot.isEmpty():
        spans = _sorted(_cut_out(rows, chosen, size), size, shard_bytes)
    else:
        spans = _sorted(_cut_out(rows, chosen.join(hot, "key", "left_anti"), size), size, shard_bytes)
        parents = _cut_out(rows, chosen.join(hot, "key", "left_semi"), size).dropDuplicates(_SEGMENT)
        parents = written(parents.select(*_SEGMENT, F.xxhash64(*_SEGMENT).alias("rid"), F.xxhash64(F.lit("second"), *_SEGMENT).alias("rid2"), F.col("bytes").alias("raw")), "hot")
        inner = _repeated(parents, size, shard_bytes, finer[0], finer[1:])
        inner = inner.groupBy("rid", "rid2").agg(F.collect_list(F.array("start", "end")).alias("spans"))  # of one segment's windows
        spans = spans.unionByName(parents.drop("raw").join(inner, ["rid", "rid2"]).select(*_SEGMENT, "spans"))
    spans = spans.groupBy(*_SEGMENT).agg(F.first("spans").alias("spans"))  # repeated rows cut theirs twice
    known = written(one.select(*_SEGMENT, "copies").join(spans, _SEGMENT, "left"), "spans")
    part = mixed.join(known, _SEGMENT)
    everything = F.array(F.array(F.lit(0).cast("bigint"), F.col("n")))
    part = part.withColumn("span", F.explode(F.when(F.col("copies") > 1, everything).otherwise(F.col("spans"))))
    part = part.select("rid", "rid2", (F.col("first") + F.col("span")[0]).alias("start"), (F.col("first") + F.col("span")[1]).alias("end"))
    return out.unionByName(part)


def repeated_windows(docs: DataFrame, text: str = "text", size: int = SIZE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rid, rid2, start, end: runs of windows of each text that also start elsewhere."""
    return _repeated(_keyed(docs, text), size, shard_bytes, None, tuple(w for w in WIDTHS if w < size))


def _removed(docs: DataFrame, text: str, size: int, shard_bytes: int, f, new: dict[str, str]) -> DataFrame:
    lists = repeated_windows(docs, text, size, shard_bytes).groupBy("rid", "rid2").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return add_columns(_with_texts(_keyed(docs, text), lists, "left"), ["doc_id"], ["raw", "runs"], f, new)


def _cover(raw: bytes, runs, size: int) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs."""
    if runs is None or not len(runs):
        return raw, 0
    spans: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"] + size - 1) for r in runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), len(spans)


def removal_digests(docs: DataFrame, text: str = "text", size: int = SIZE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(texts: list[bytes], lists: list) -> list[list]:
        out = []
        for raw, runs in zip(texts, lists):
            kept, n = _cover(raw, runs, size)
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        return [list(x) for x in zip(*out)] if out else [[]] * 4

    return _removed(docs, text, size, shard_bytes, run, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"})


def kept_bytes(docs: DataFrame, text: str = "text", size: int = SIZE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and the bytes that stay (a cut may fall inside a character)."""
    run = lambda texts, lists: [[_cover(raw, r, size)[0] for raw, r in zip(texts, lists)]]
    return _removed(docs, text, size, shard_bytes, run, {"kept": "binary"})
