"""Document fingerprints by randomised edit embedding, bit-sampled bands and verification.

All texts take the same random walk: at output position j the current character is written, and a random bit that only the
position and the character decide says whether the walk goes on to the next one. Two texts of small edit distance soon walk
in step again behind an edit, so they agree in most output positions: edit distance becomes Hamming distance. A character
is written for as many positions as its bits are 0, which a table gives at once (bits repeat after ``PERIOD`` positions), so a
text takes one step for each of its characters.

A fingerprint samples ``COORDINATES`` positions of the output. Each is the position of least random priority among all
positions of the output, so it depends on the output's length alone, texts of like length mostly share it, and short and
long texts are sampled alike. A coordinate is one hexadecimal digit, a hash of position and character. Digits that agree by chance
(1 in 16) are taken off: ``likeness`` estimates the share of the longer output's positions in which two texts agree.

Bands of sampled positions and their characters, of several independent walks, are the keys under which texts of high
likeness meet (``near_groups``); candidates are verified by their exact edit distance.

Defined cases: a NULL text is empty; empty texts are like one another and like nothing else. Equal texts have equal
fingerprints. The next document is the next row by doc_id (NULL first), then by a hash of the text; after the last comes the first, and a
single row is its own next one. Repeated rows are separate rows. Texts are taken whole. An empty table gives no rows. Other columns, also such
with clashing names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treestat.llm.graph import components
from treestat.llm.shingles import mix, slices
from treestat.llm.tables import add_columns, held
from treestat.session import written

COORDINATES = 128
#: A walk may stay out of step for long behind an edit, so bands come from several walks; each has so many bands of so many rows.
WALKS, BANDS, ROWS = 6, 6, 5
#: Characters of the text, from the one that is written on, that make up a row of a band.
GRAM = 4
#: Least similarity of near duplicates: 1 - edit distance / length of the longer text.
SIMILARITY = 0.8
PERIOD, CLASSES = 4096, 256
SLICE_CHARS = 4_000_000
#: Texts that walk abreast at least; what is left of longer ones is walked text by text.
ABREAST = 48
_FAR = 1 << 40
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Walk:
    """The shared randomness: how long a character stays, and which positions are sampled."""

    def __init__(self, coordinates: int, number: int = 0) -> None:
        bits = (mix((np.arange(1, CLASSES * PERIOD + 1, dtype=np.uint64) + np.uint64(number << 40)) * _GOLD) >> np.uint64(63)).astype(bool).reshape(CLASSES, PERIOD)
        bits[:, 0] |= ~bits.any(1)
        stay = np.zeros((CLASSES, PERIOD), np.int64)
        at = np.full(CLASSES, PERIOD * 3)
        for j in range(2 * PERIOD - 1, -1, -1):  # positions until the next bit that is set, itself included
            at = np.where(bits[:, j % PERIOD], j, at)
            if j < PERIOD:
                stay[:, j] = at - j + 1
        self.stay = stay.reshape(-1)
        self.rows = [tuple(r) for r in stay.tolist()]
        self.kinds = (mix(np.arange(0x10000, dtype=np.uint64) + _GOLD) & np.uint64(CLASSES - 1)).astype(np.int64)
        self.records = [self._records(t + 10_000 * number) for t in range(coordinates)]

    @staticmethod
    def _records(t: int) -> np.ndarray:
        """Positions of a new least priority for one coordinate: after r positions the next one is beyond m with probability r / m."""
        out, r, k = [0], 1, 0
        while r < _FAR:
            k += 1
            u = (int(mix(np.array([(t + 1) * 1_000_003 + k], np.uint64) * _GOLD)[0] >> np.uint64(11)) + 1) * 2.0**-53
            r = int(r / u) + 1
            out.append(r - 1)
        return np.array(out, np.int64)

    def go(self, codes: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The output position at which each character starts, texts one after the other, and where each text ends.
        ``begin``: the position at which each text starts."""
        kind = np.where(codes < 0x10000, self.kinds[np.minimum(codes, 0xFFFF)], codes & (CLASSES - 1)).astype(np.int64)
        base, at = kind * PERIOD, np.zeros(len(codes), np.int64)
        order = np.argsort(-sizes, kind="stable")
        start, here, size = (np.cumsum(sizes) - sizes)[order], begin.astype(np.int64)[order], sizes[order]
        done, abreast = 0, np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left").tolist()
        for n in abreast:
            if n < ABREAST:
                break
            i, h = start[:n] + done, here[:n]
            at[i] = h
            h += self.stay[base[i] + (h & (PERIOD - 1))]
            done += 1
        rows, mask = self.rows, PERIOD - 1
        for k in range(int(np.searchsorted(-size, -done, side="left"))):
            a, b, p, out = int(start[k]) + done, int(start[k] + size[k]), int(here[k]), []
            for c in kind[a:b].tolist():
                out.append(p)
                p += rows[c][p & mask]
            at[a:b], here[k] = out, p
        end = np.empty(len(sizes), np.int64)
        end[order] = here
        return at, end

    def places(self, ends: np.ndarray) -> np.ndarray:
        """The sampled positions of outputs of these lengths; -1 for empty ones."""
        return np.stack([np.where(ends > 0, r[np.searchsorted(r, ends) - 1], -1) for r in self.records], 1)


def walk(coordinates: int) -> Walk:
    """The worker's walk."""
    return held(("walk", coordinates), lambda: Walk(coordinates))


def walks() -> list[Walk]:
    """The worker's walks for bands."""
    return held("walks", lambda: [Walk(BANDS * ROWS, k) for k in range(1, WALKS + 1)])


class _Part:
    """Texts with the output positions of their characters."""

    def __init__(self, w: Walk, texts: list[str], begin: np.ndarray | None = None) -> None:
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.zeros(len(texts), np.int64) if begin is None else begin
        self.at, self.end = w.go(self.codes, self.size, begin)
        self.key = np.repeat(np.arange(len(texts), dtype=np.int64), self.size) * _FAR + self.at

    def position(self, k: np.ndarray) -> np.ndarray:
        """Where character ``k`` of each text starts, or the end."""
        i = self.start + k
        inside = k < self.size
        return np.where(inside, self.at[np.where(inside, i, 0)] if len(self.at) else 0, self.end)

    def written(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The character that each text writes at a position, which must lie inside its output."""
        return self.codes[np.searchsorted(self.key, text * _FAR + place, side="right") - 1]


def _symbols(place: np.ndarray, char: np.ndarray) -> np.ndarray:
    """A 64-bit hash of position and character."""
    return mix(mix(place.astype(np.uint64) * _GOLD) ^ (char + 1).astype(np.uint64))


def _digits(symbols: np.ndarray) -> np.ndarray:
    """One hexadecimal digit of each coordinate, another hash for each."""
    t = np.arange(1, symbols.shape[1] + 1, dtype=np.uint64) * _GOLD
    return (mix(symbols ^ t) >> np.uint64(60)).astype(np.uint8)


def _hex(digits: np.ndarray) -> list[str]:
    return [bytes(x).hex() for x in (digits[:, ::2] << 4) | digits[:, 1::2]]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, ((a == b).mean(1) - 1 / 16) * 16 / 15)


def likeness(a: str, b: str) -> float:
    """Estimated share of output positions in which the texts of two fingerprints agree, 0 to 1; 1 for equal ones."""
    x, y = (np.array([[int(c, 16) for c in f]]) for f in (a, b))
    return float(_likeness(x, y)[0])


def sampled(w: Walk, texts: list[str], gram: int = 1) -> np.ndarray:
    """The sampled symbols of each text: hashes of position and ``gram`` characters."""
    part = _Part(w, texts)
    place = w.places(part.end)
    char = np.full(place.shape, -1)
    if len(part.codes):
        left = np.repeat(part.start + part.size, part.size) - np.arange(len(part.codes))
        codes = part.codes
        for k in range(1, gram):  # characters that follow in the same text
            codes = codes * 0x110001 + np.where(left > k, np.concatenate([part.codes[k:], np.zeros(min(k, len(part.codes)), np.int64)]) + 1, 0)
        part.codes = codes
        text = np.repeat(np.arange(len(texts)), place.shape[1]).reshape(place.shape)
        ok = place >= 0
        char[ok] = part.written(text[ok], place[ok])
    return _symbols(place, char)


def fingerprint(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts, as hexadecimal digits."""
    return _hex(_digits(sampled(walk(COORDINATES), texts)))


def _edited(texts: list[str]) -> Iterator[tuple]:
    """For each text but the last: characters, digest of its edited text, both fingerprints, and both likenesses."""
    w = walk(COORDINATES)
    part = _Part(w, texts)
    own = texts[:-1]
    size = part.size[:-1]
    kept = size - size // 2
    more = [nxt[: n // 2] for n, nxt in zip(size.tolist(), texts[1:])]
    turn = part.position(part.size - part.size // 2)[:-1]
    rest = _Part(w, more, turn)  # the walk goes on where the kept half ends
    whole, cut = w.places(part.end), w.places(rest.end)
    text = np.repeat(np.arange(len(texts)), COORDINATES).reshape(whole.shape)
    char = np.full(whole.shape, -1)
    ok = whole >= 0
    char[ok] = part.written(text[ok], whole[ok]) if ok.any() else 0
    new = np.full(cut.shape, -1)
    first, second = (cut >= 0) & (cut < turn[:, None]), cut >= turn[:, None]
    second &= cut >= 0
    if first.any():
        new[first] = part.written(text[:-1][first], cut[first])
    if second.any():
        new[second] = rest.written(text[:-1][second], cut[second])
    digits, edited = _digits(_symbols(whole, char)), _digits(_symbols(cut, new))
    sha = [hashlib.sha256((t[:k] + m).encode("utf-8", "surrogatepass")).hexdigest() for t, k, m in zip(own, kept.tolist(), more)]
    return size, sha, _hex(digits[:-1]), _hex(edited), _likeness(digits[:-1], edited), _likeness(digits[:-1], digits[1:])


_MADE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _MADE.split(", ")]
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _walked(batches: Iterator[pa.RecordBatch], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition. The last one has no next one here: it leaves its text, as the first one does."""
    ids: list = []
    texts: list[str] = []
    chars, pid, first = 0, TaskContext.get().partitionId(), True
    names = ["doc_id", *_NAMES, "pid", "is_first", "carried"]

    def ends(is_first: bool, doc_id, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc_id], id_kind), *(pa.nulls(1, k) for k in _KINDS), pa.array([pid], pa.int32()), pa.array([is_first]), pa.array([text], pa.string())], names)

    def rows() -> pa.RecordBatch:
        n, made = len(texts) - 1, _edited(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids[:-1], id_kind), *(pa.array(x, k) for x, k in zip(made, _KINDS)), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names)

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if first:
                yield ends(True, i, t)
                first = False
            ids.append(i)
            texts.append(t)
            chars += len(t)
            if len(texts) > 1 and chars >= SLICE_CHARS:
                yield rows()
                ids, texts, chars = ids[-1:], texts[-1:], len(t)
    if texts:
        if len(texts) > 1:
            yield rows()
        yield ends(False, ids[-1], texts[-1])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row.

    Rows are dealt by ranges of doc_id and sorted there, so texts are moved once; only the first and the last text of each
    partition meet those of its neighbours in a second step.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    order = ["doc_id", "h", "t"]
    rows = docs.select("doc_id", t.alias("t"), F.xxhash64(t).alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _walked(_chained(b, batches), b.schema.field("doc_id").type)

    made = written(rows.select("doc_id", "t").mapInArrow(run, f"doc_id {kind}, {_MADE}, pid int, is_first boolean, carried string"), "fingerprints")
    edges = made.filter("is_first IS NOT NULL")
    firsts = edges.filter("is_first").select(F.col("pid").alias("next_pid"), F.col("carried").alias("following"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(whole)).alias("next_pid")
    after = edges.filter("is_first").select("pid", following)  # one row for each partition
    lasts = edges.filter("NOT is_first").select("doc_id", "pid", "carried").join(after, "pid").join(firsts, "next_pid")

    def finish(a: list[str], b: list[str]) -> list[list]:
        done = [[x[0] for x in _edited([p, q])] for p, q in zip(a, b)]
        return [list(x) for x in zip(*done)] if done else [[] for _ in _NAMES]

    resolved = add_columns(lasts.select("doc_id", "carried", "following"), ["doc_id"], ["carried", "following"], finish, dict(x.split() for x in _MADE.split(", ")))
    return made.filter("is_first IS NULL").select("doc_id", *_NAMES).unionByName(resolved)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def band_keys(texts: list[str]) -> np.ndarray:
    """One 64-bit key for each band of each walk: its sampled positions and the characters there."""
    out = []
    for number, w in enumerate(walks()):
        s = sampled(w, texts, GRAM).reshape(len(texts), BANDS, ROWS)
        key = np.zeros(s.shape[:2], np.uint64) + np.arange(number * BANDS + 1, (number + 1) * BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * _GOLD + s[:, :, r])
        out.append(key.view(np.int64))
    return np.concatenate(out, 1)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose edit distance leaves a similarity of ``least``; lengths too far apart need no distance."""
    a = texts.select(F.col("rep").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a")
    longer, shorter = (f(F.char_length("ta"), F.char_length("tb")) for f in (F.greatest, F.least))
    both = both.withColumn("most", F.floor(longer * F.lit(1 - least) + 1e-9).cast("int")).filter(longer - shorter <= F.col("most"))
    return both.filter(F.expr("levenshtein(ta, tb, most)") >= 0).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id with the same text), group_id (least doc_id of its group), kept.

    Texts that share a band are candidates, verified by edit distance. Equal texts are one class from the start. In every
    bucket all are compared with the least one, and then members of other components than the bucket's main one with all
    members that are in another component than they. Empty texts and rows without doc_id are in no group.
    """

    def run(texts: list[str]) -> list[list]:
        return [[k for a, b in slices(texts) for k in band_keys(texts[a:b])]]

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("cls", F.sha2("t", 256))
    member = rows.select("doc_id", "cls", (F.col("t") == "").alias("empty"))
    classes = rows.filter("t <> ''").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("t").alias("t"))
    banded = written(add_columns(classes, ["cls", "rep", "t"], ["t"], run, {"bands": "array<long>"}), "banded")
    texts = banded.select("rep", "t")
    spread = banded.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first <> last")
    buckets = written(spread.join(shared.select("key", "first").hint("merge"), "key"), "buckets")
    star = buckets.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_verified(star, texts, least), "links")
    found = components(links)

    now = buckets.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", -F.col("root"))).alias("main")).filter("roots > 1")
    mixed = written(now.join(main.select("key", "main").hint("merge"), "key"), "mixed")
    left = mixed.filter("root <> main").select("key", F.col("rep").alias("x"), F.col("root").alias("rx"))
    right = mixed.select("key", F.col("rep").alias("y"), F.col("root").alias("ry"))
    across = left.join(right.hint("merge"), "key").filter("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = links.unionByName(written(_verified(across, texts, least), "links"))
    found = components(links)

    named = member.join(banded.select("cls", "rep"), "cls", "left").select("doc_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"))
    out = named.join(found.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), (F.coalesce("root", "class_id") == F.col("doc_id")).alias("kept"))
