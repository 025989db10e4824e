"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

Documents are grouped by their full text; every distinct text is tokenized by both tokenizers and aligned once, with the
number of its copies as weight. Where a token of A and a token of B end at the same byte, the two are linked and the text
is cut into groups. Counts of linked id pairs are summed over the corpus, and the measures of each distinct text are
joined back to its doc_ids by the digest of the text.

Both tokenizers work unit by unit: a unit starts at a space that follows a character other than white space. No pattern of
the byte-level tokenizer goes from such a character over a space, and no piece of the other one has its space mark behind
another character (checked on loading), so every unit's end is a common end of tokens. Units repeat; a worker keeps what it
found for those met before in a table of bounded size.

Of two linked tokens one's bytes are a suffix of the other's, so the pairs that can ever be linked are counted from the
vocabularies alone (``pair_bound``). The table of pair counts never exceeds that number however large the corpus is, which
is why it may be broadcast.

Defined cases: NULL or empty texts, and texts whose tokens' bytes are not a space and the text, have no tokens: zeros and an
empty digest. Special strings in a text are ordinary text. Texts are taken whole. Every row of ``docs`` gives one row, also
repeated rows and rows without doc_id. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treestat.llm.shingles import slices
from treestat.llm.tables import held
from treestat.session import written

MEMO_UNITS, MEMO_CHARS = 400_000, 32
SLICE_CHARS = 1_000_000
#: Links counted at once in a task.
COUNT_LINKS = 1_000_000
#: White space before a space, and characters that some engines take for white space: no unit starts there.
_ALSO = "\u180e\u200b\ufeff"
_JOINT = re.compile(f"[\\s{_ALSO}] ")
_JOINED = tuple(c for c in map(chr, range(0x3100)) if c.isspace()) + tuple(_ALSO)


def _byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others in order from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and units met before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = _byte_chars()
        special = {k for k, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, k in self.a.get_vocab().items():
            if k not in special:
                self.a_bytes[k] = bytes(chars[c] for c in token)
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        if bad := [p for p in map(self.b.id_to_piece, range(len(self.b_bytes))) if "▁" in p.lstrip("▁")]:
            raise ValueError(f"pieces go over the start of a word: {bad[:5]}")
        if self.b.encode_as_pieces("\n ") != ["▁", "<0x0A>", "▁"]:
            raise ValueError("the model has no dummy prefix or no byte fallback")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.radix = len(self.b_bytes)
        self.kind = np.dtype("<u4" if len(self.a_bytes) * self.radix < 1 << 32 else "<u8")
        self.memo: dict[str, tuple[int, int, bytes, bytes] | None] = {}

    def _piece(self, k: int) -> bytes:
        if self.b.is_control(k) or self.b.is_unknown(k):
            return b""
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def bound(self) -> int:
        """How many id pairs can be linked at all: of two tokens that end together one is a suffix of the other."""
        ends: dict[bytes, int] = {}
        for t in self.b_bytes:
            ends[t] = ends.get(t, 0) + 1
        n = sum(ends.get(t[k:], 0) for t in self.a_bytes for k in range(len(t)))
        own: dict[bytes, int] = {}
        for t in self.a_bytes:
            own[t] = own.get(t, 0) + 1
        return n + sum(own.get(t[k:], 0) for t in self.b_bytes for k in range(1, len(t)))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for units, given without their first space."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        return a, [x or self.b.encode("\n ")[2:] for x in b]

    def align(self, units: list[str]) -> Iterator[tuple[int, int, bytes, bytes] | None]:
        """Of each unit: numbers of tokens, groups as text, links as numbers; None where bytes differ from the unit."""
        a, b = self.encode(units)
        raw = [f" {u}".encode("utf-8", "surrogatepass") for u in units]
        ok = self._equal(raw, a, b)
        if not all(ok):
            a, b = ([x for x, good in zip(t, ok) if good] for t in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        _, p, q = np.intersect1d(np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b]), assume_unique=True, return_indices=True)
        links = (flat_a[p] * self.radix + flat_b[q]).astype(self.kind).tobytes()
        name_a, name_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip((p + 1).tolist(), (q + 1).tolist()):
            one = name_a[i] if x == i + 1 else ",".join(name_a[i:x])
            two = name_b[j] if y == j + 1 else ",".join(name_b[j:y])
            groups.append(f"{one}|{two}")
            i, j = x, y
        ends = np.searchsorted(p, np.cumsum([len(x) for x in a])).tolist()
        found, last, size = iter(zip(a, b, ends)), 0, self.kind.itemsize
        for good in ok:
            if not good:
                yield None
                continue
            x, y, end = next(found)
            yield len(x), len(y), ";".join(groups[last:end]).encode(), links[last * size : end * size]
            last = end

    def _equal(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether the bytes of both encodings are those of the unit."""
        whole, ends, same = b"".join(raw), np.cumsum([len(r) for r in raw]), True
        for ids, table, size in ((a, self.a_bytes, self.a_len), (b, self.b_bytes, self.b_len)):
            flat = list(chain.from_iterable(ids))
            at = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum([len(x) for x in ids])]
            same = same and b"".join(map(table.__getitem__, flat)) == whole and bool((at == ends).all())
        if same:
            return [True] * len(raw)
        return [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for r, x, y in zip(raw, a, b)]

    def learn(self, units: set[str]) -> dict:
        """The table with all the given units in it; long ones go with the next call."""
        new = [u for u in units if u not in self.memo]
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo = {u: self.memo[u] for u in units if u in self.memo and len(u) <= MEMO_CHARS}
            new = [u for u in units if u not in self.memo]
        new.sort(key=len)
        for s, e in slices(new, 100_000, 8_000):
            self.memo.update(zip(new[s:e], self.align(new[s:e])))
        return self.memo

    def forget(self, units: set[str]) -> None:
        for u in units:
            if len(u) > MEMO_CHARS:
                del self.memo[u]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Numbers of tokens, groups and links of whole texts; zeros and no bytes for those without tokens."""
        for s, e in slices(texts, SLICE_CHARS):
            split = [units(t) for t in texts[s:e]]
            seen = set(chain.from_iterable(split))
            memo = self.learn(seen)
            for us in split:
                try:
                    n_a, n_b, groups, links = zip(*[memo[u] for u in us])
                except (TypeError, ValueError):  # a unit without tokens, or no unit
                    yield 0, 0, b"", b""
                else:
                    yield sum(n_a), sum(n_b), b";".join(groups), b"".join(links)
            self.forget(seen)


def units(text: str) -> list[str]:
    """The units of a space and ``text``, each without its first space; none of an empty text."""
    if not text:
        return []
    parts = text.split(" ")
    if not _JOINT.search(f" {text}"):
        return parts
    out, open_ = [], False
    for p in parts:
        if open_:
            out[-1] += f" {p}"
        else:
            out.append(p)
        open_ = not p or p.endswith(_JOINED)
    return out


def pair(a_path: str, b_path: str) -> Pair:
    """The worker's pair of tokenizers."""
    return held(("pair", a_path, b_path), lambda: Pair(a_path, b_path))


def pair_bound(a_path: str, b_path: str) -> int:
    """The greatest number of different id pairs that any corpus can link."""
    return Pair(a_path, b_path).bound()


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """One row for each distinct text that is not empty: digest (SHA-256 of the text), copies, n_a, n_b, links (one number
    a * (size of B) + b for each link, as bytes), groups_sha256, and with ``with_groups`` the groups as text."""
    texts = docs.filter(F.col(text) != "").groupBy(F.col(text).alias("t")).agg(F.count("*").alias("copies"))
    rows = texts.select(F.unhex(F.sha2("t", 256)).alias("digest"), "copies", "t")
    names = ["digest", "copies", "n_a", "n_b", "links", "groups_sha256", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(2).to_pylist()
            for s, e in slices(texts, SLICE_CHARS):  # what a slice has made is handed on before the next one
                b = whole.slice(s, e - s)
                n_a, n_b, links, sha, groups = [], [], [], [], []
                for a, k, g, found in pair(a_path, b_path).texts(texts[s:e]):
                    n_a.append(a)
                    n_b.append(k)
                    links.append(found)
                    sha.append(hashlib.sha256(g).hexdigest() if g else "")
                    if with_groups:
                        groups.append(g.decode())
                more = [pa.array(groups, pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(links, pa.binary()), pa.array(sha, pa.string()), *more], names)

    return rows.mapInArrow(run, "digest binary, copies long, n_a long, n_b long, links binary, groups_sha256 string" + (", groups string" if with_groups else ""))


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold the pair; copies count. At most ``pair_bound`` rows."""

    def summed(codes: list[bytes], copies: list[int], kind: np.dtype) -> pa.RecordBatch:
        code = np.frombuffer(b"".join(codes), kind)
        weight = np.repeat(np.array(copies, np.int64), [len(c) // kind.itemsize for c in codes])
        order = np.argsort(code, kind="stable")
        code, weight = code[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.add.reduceat(weight, first)
        return pa.RecordBatch.from_arrays([pa.array(code[first].astype(np.int64)), pa.array(n)], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        codes, copies, held_ = [], [], 0
        for b in batches:
            for c, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c:
                    codes.append(c)
                    copies.append(k)
                    held_ += len(c) // p.kind.itemsize
                if held_ >= COUNT_LINKS:
                    yield summed(codes, copies, p.kind)
                    codes, copies, held_ = [], [], 0
        if codes:
            yield summed(codes, copies, p.kind)

    radix = Pair(a_path, b_path).radix
    parts = rows.select("links", "copies").mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n")).select(F.expr(f"code div {radix}").alias("a_id"), (F.col("code") % radix).alias("b_id"), "n")


def _measured(rows: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """digest, n_a, n_b, n_links, n_best, count_sum, groups_sha256 of every distinct text with tokens."""
    p = Pair(a_path, b_path)
    best = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))
    table = best.select((F.col("a_id") * p.radix + F.col("b_id")).alias("code"), "n", "best").toArrow()
    if len(table) > p.bound():
        raise ValueError(f"{len(table)} pairs are linked; the vocabularies allow {p.bound()}")
    order = np.argsort(table["code"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((table["code"].to_numpy()[order].astype(p.kind), table["n"].to_numpy()[order], table["best"].to_numpy()[order]))
    size, kind = p.kind.itemsize, p.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counted, is_best = shared.value
        for whole in batches:
            every = whole.column(3).to_pylist()
            for s, e in slices(every, COUNT_LINKS * size):
                b, links = whole.slice(s, e - s), every[s:e]
                n = np.array([len(x) // size for x in links], np.int64)
                at = np.searchsorted(codes, np.frombuffer(b"".join(links), kind))
                bounds = np.concatenate([[0], np.cumsum(n)])
                good, total = (np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (is_best, counted))
                out = [n, good[bounds[1:]] - good[bounds[:-1]], total[bounds[1:]] - total[bounds[:-1]]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, out), b.column(4)], ["digest", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"])

    some = rows.filter("n_a > 0").select("digest", "n_a", "n_b", "links", "groups_sha256")
    return some.mapInArrow(run, "digest binary, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    A group ends where a token of A and one of B end together, which is a link, so there are as many links as groups.
    """
    rows = written(aligned(docs, a_path, b_path, text), "aligned")
    measures = _measured(rows, pair_counts(rows, a_path, b_path), a_path, b_path)
    ids = docs.select("doc_id", F.when(F.col(text) != "", F.unhex(F.sha2(F.col(text), 256))).alias("digest"))
    out = ids.join(measures, "digest", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_links").alias("n_groups"), zero("n_links").alias("n_links"),
        zero("n_best").alias("n_best"), zero("count_sum").alias("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
