"""Phrase collocations: n-grams counted by an index of word ids in every shard, summed over the shards, scored exactly.

A task cuts its documents into shards of bounded size. In a shard, words are numbered and the word ids of all pieces stand
in one sequence with a separator between pieces. Two Burrows-Wheeler transforms of it are kept: the forward one lists the
word before each position, positions sorted by what follows; the reverse one lists the word after each position, positions
sorted by what stands before. A phrase is an interval of the same length in both. An interval is extended to the left by
the words of the forward transform that lie in it, which fixes the interval in the reverse transform too, and to the right by
those of the reverse one, all intervals of a depth at once. So every n-gram up to the depth asked for comes with its count
and its extensions, separators never become part of it, and the work is a few sorts of the shard.

Each shard sends its different phrases with their counts and right extensions, packed by what stands before their last word
and a few bits of that word's hash (``SALTS``): one row holds many phrases, and what follows a frequent word is dealt to several
tasks. Rows are dealt by that key and counts are summed where they arrive. A frequent phrase has one entry from each shard.

Defined cases: NULL texts are empty; texts without words count nothing; a NULL language is ``und``. Repeated rows are
separate documents, whatever their doc_id. Texts are taken whole. Ties are settled by the phrase in byte order, so the
result has one order only. An empty table gives no rows. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treestat.llm.tables import release
from treestat.session import written

#: Bytes of text in a shard, about 0.8 million words. A longer text is a shard of its own.
SHARD_BYTES = 5_000_000
#: Parts into which what follows a phrase is dealt, and single words are.
SALTS, WORD_SALTS = 16, 4096
LEAST_COUNT, MOST_WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer one has this share of its occurrences, in hundredths.
WITHIN = 50
#: Lower case for A-Z; a space for tabs; a line feed for what ends a piece.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Ids(dict):
    """word -> its number in the shard, from 1; 0 separates pieces, -1 is no word."""

    def __init__(self, names: list) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.names = names

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = k = len(self.names) - 1
        return k


class WordIndex:
    """Forward and reverse Burrows-Wheeler transforms of a sequence of word ids with two separators (0) before and one behind."""

    def __init__(self, seq: np.ndarray, words: int, depth: int) -> None:
        """``words``: ids are below it. ``depth``: words of the longest phrase."""
        self.seq, self.words = seq, words
        inner = np.arange(1, len(seq) - 1, dtype=np.int32)
        self.forward = inner[np.argsort(seq[inner], kind="stable")]
        self.before = seq[self.forward - 1]
        #: Position of the first suffix of each word; those of separators come first.
        self.first = np.searchsorted(seq[self.forward], np.arange(words + 1))
        rank = seq.astype(np.int64)
        for k in range(1, depth - 1):  # the order by the word and those before it, as deep as intervals need
            rank = (rank if k == 1 else np.unique(rank, return_inverse=True)[1]) * words
            rank[k:] += seq[:-k]
        self.reverse = inner[np.argsort(rank[1:-1], kind="stable")]
        del rank
        self.after = seq[self.reverse + 1]
        self._place: np.ndarray | None = None

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the words that occur."""
        n = np.diff(self.first)
        w = np.flatnonzero(n[1:]) + 1
        return w, n[w]

    def _extended(self, bwt: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All words that a transform has in each interval: interval, word, count, offset of the word's run among the
        interval's sorted words, and where the word stands first."""
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int32) - np.repeat((start - lo).astype(np.int32), size)
        key = np.repeat(np.arange(len(lo)) * self.words, size)
        key += bwt[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.append(run, len(key)))
        parent, word = key[run] // self.words, key[run] % self.words
        keep = word > 0
        return parent[keep], word[keep], n[keep], (run - start[parent])[keep], at[order[run]][keep]

    def extend_left(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs (left word, word) of single words: index of the word in ``w``, left word, count, interval in the reverse transform."""
        parent, left, count, offset, _ = self._extended(self.before, self.first[w], n)
        return parent, left, count, self.first[w[parent]] + offset

    def extend_right(self, lo: np.ndarray, size: np.ndarray, more: bool) -> tuple[np.ndarray, ...]:
        """Extensions of intervals of the reverse transform: index, right word, count, and with ``more`` the new intervals."""
        parent, right, count, _, at = self._extended(self.after, lo, size)
        if not more:
            return parent, right, count, at
        if self._place is None:  # from a place of the transform to that of the position one word on
            self._place = np.empty(len(self.after), np.int64)
            order = np.argsort(self.after, kind="stable")
            self._place[order] = np.arange(len(order))
        return parent, right, count, self._place[at]


def _sequence(texts: dict[str, list[bytes]]) -> tuple[np.ndarray, list[bytes], list[str], np.ndarray]:
    """Word ids of all pieces with separators; words by id, languages, and the language of each id. Words of different languages differ."""
    names: list = [b""]
    parts, starts = [np.zeros(2, np.int32)], []
    for some in texts.values():
        starts.append(len(names))
        ids = _Ids(names)
        for t in some:
            w = t.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
            row = np.fromiter(map(ids.__getitem__, w), np.int32, len(w))
            parts += [row[row >= 0], np.zeros(1, np.int32)]
    lang = np.searchsorted(starts, np.arange(len(names)), side="right") - 1
    return np.concatenate(parts), names, list(texts), lang


def shard_rows(texts: dict[str, list[bytes]], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, tail) of one shard. Key: language, what stands before the last word of phrases, salt; a line feed between
    them. Tail: those phrases, a line feed between them: the last word and words that follow the phrase, a space between
    them, each word with its count after a tab unless that is 1."""
    seq, words, langs, lang = _sequence(texts)
    names = pa.array(words, pa.binary())
    salt = np.fromiter(map(crc32, words), np.int64, len(words))
    heads = pa.array([f"{x}\n".encode() for x in langs], pa.binary())
    index = WordIndex(seq, len(words), most)
    word, n = index.unigrams()
    if not len(word):
        return
    total = np.zeros(len(langs), np.int64)
    np.add.at(total, lang[word], n)
    none = pa.array([b""] * len(langs), pa.binary())
    yield from _packed(heads, np.arange(len(langs)), _numbered(none, total), np.zeros(len(langs), np.int64), 1)  # all words of a language
    yield from _packed(heads, lang[word], _numbered(names.take(pa.array(word)), n), salt[word], WORD_SALTS)
    if most < 2:
        return
    parent, left, n, lo = index.extend_left(word, n)
    before = pc.binary_join_element_wise(heads.take(pa.array(np.maximum(lang, 0))), names, b"")  # language and word, by id
    last, group = word[parent], left
    del parent, left
    for depth in range(2, most + 1):
        own = n if depth == 2 else np.zeros(len(n), np.int64)  # longer ones are counted as what follows a shorter one
        segments = _numbered(names.take(pa.array(last)), own)
        if depth < most:
            parent, right, count, then = index.extend_right(lo, n, depth + 1 < most)
            bounds = pa.array(np.searchsorted(parent, np.arange(len(n) + 1)).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, _numbered(names.take(pa.array(right)), count)), b" ")
            segments = pc.if_else(pc.equal(pc.binary_length(joined), 0), segments, pc.binary_join_element_wise(segments, joined, b" "))
            del joined
        if depth == 2 or depth < most:
            yield from _packed(before, group, segments, salt[last], SALTS)
        if depth + 1 < most:
            phrase = pc.binary_join_element_wise(before.take(pa.array(group)), names.take(pa.array(last)), b" ")
            before, group, last, n, lo = phrase, parent, right, count, then


def _numbered(words: pa.Array, n: np.ndarray) -> pa.Array:
    """Words with a tab and their count where it is not 1."""
    text = pc.binary_join_element_wise(words, pc.cast(pc.cast(pa.array(n), pa.string()), pa.binary()), b"\t")
    return pc.if_else(pa.array(n == 1), words, text)


def _packed(before: pa.Array, group: np.ndarray, segments: pa.Array, salt: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """Segments packed by group and salt. ``before``: start of the key by group."""
    code = group.astype(np.int64) * salts + salt % salts
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = np.append(first[1:], len(code))
    for a in range(0, len(first), 50_000):
        some, to = first[a : a + 50_000], ends[a : a + 50_000]
        part = segments.take(pa.array(order[some[0] : to[-1]]))
        tail = pc.binary_join(pa.ListArray.from_arrays(pa.array((np.append(some, to[-1]) - some[0]).astype(np.int32)), part), b"\n")
        mark = pa.array([f"{x:x}".encode() for x in (code[some] % salts).tolist()], pa.binary())
        key = pc.binary_join_element_wise(before.take(pa.array(code[some] // salts)), mark, b"\n")
        yield pa.RecordBatch.from_arrays([pc.cast(key, pa.string()), pc.cast(tail, pa.string())], ["key", "tail"])


def phrase_counts(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, words, n: all phrases of up to ``most`` words with at least ``least`` occurrences, and for each language
    the empty phrase (words 0) with the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        texts: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if size and size + len(t) > SHARD_BYTES:
                    yield from shard_rows(texts, most)
                    texts, size = {}, 0
                texts.setdefault(x, []).append(t)
                size += len(t)
        yield from shard_rows(texts, most)

    rows = docs.filter(F.col(text) != "").select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    dealt = rows.mapInArrow(run, "key string, tail string").repartition("key")
    segments = dealt.select("key", F.explode(F.split("tail", "\n")).alias("s")).select("key", F.split("s", " ").alias("w"))
    each = segments.select("key", F.substring_index(F.get("w", F.lit(0)), "\t", 1).alias("last"), F.posexplode("w").alias("pos", "x"))
    number = F.when(F.contains("x", F.lit("\t")), F.substring_index("x", "\t", -1).cast("long")).otherwise(F.lit(1).cast("long"))
    parts = each.select("key", "last", F.when(F.col("pos") > 0, F.substring_index("x", "\t", 1)).otherwise("").alias("more"), number.alias("n"))
    summed = parts.groupBy("key", "last", "more").agg(F.sum("n").alias("n"))  # dealt by key already
    kept = summed.filter((F.col("n") >= least) | (F.col("last") == "") & (F.col("n") > 0))
    end = F.substring_index("key", "\n", -2)  # what stands before, and the salt
    words = [F.nullif(x, F.lit("")) for x in (F.substring_index(end, "\n", 1), F.col("last"), F.col("more"))]
    kept = kept.select(F.left("key", F.char_length("key") - F.char_length(end) - 1).alias("lang"), F.concat_ws(" ", *words).alias("phrase"), "n")
    return kept.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "n")


def _cuts(candidates: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Every cut of every candidate: lang, phrase, words, a, k, l, r."""
    at = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    w = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "words", "a", at.alias("k"), w.alias("w"))
    cut = cut.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("x"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("y"))
    known = counts.filter(F.col("words").between(1, most - 1))
    left = known.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r"))
    return cut.join(left, ["lang", "x"]).join(right, ["lang", "y"]).select("lang", "phrase", "words", "a", "k", "l", "r")


def _contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longest: every phrase inside a longer candidate, and the most occurrences of such a one."""
    w = F.split("phrase", " ")
    longer = candidates.filter("words > 2").select("lang", w.alias("w"), "words", "a")
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    places = sizes.select("lang", "w", "m", "a", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    inner = places.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, within: int = WITHIN, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``most`` words of each language.

    Score of a cut is floor(10^6 a^2 / (l r)), in decimals of 38 digits; the lowest cut counts, of equal ones the first.
    """
    counts = written(phrase_counts(docs, most, least, text, lang), "phrases")
    candidates = counts.filter("words > 1").withColumnRenamed("n", "a")
    exact = F.expr("CAST((CAST(a AS DECIMAL(38, 0)) * a * 1000000) DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)")
    cuts = _cuts(candidates, counts, most).withColumn("score", exact)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    whole = best.join(_contained(candidates), ["lang", "phrase"], "left").filter(F.coalesce(F.col("longest") * 100 < F.col("a") * within, F.lit(True)))
    rows = written(whole.select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each language are among the first of its parts, so no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").groupBy("lang").agg(F.max("n").alias("n"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
