"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. One pass over the texts finds the pattern spans and long runs of token characters
(candidates) and is written to the shared folder; what the patterns matched are the samples labelled random, the words
of a bounded sample of documents the samples labelled ordinary. From both come character transition counts with
smoothing; what pattern spans leave of a candidate, in pieces of ``CANDIDATE_CHARS`` or more, is a ``random`` span if
random strings explain it better than ordinary identifiers by ``MIN_RATIO`` nats.

Defined cases: NULL or empty text has no spans, zero counts and the digest of the empty string. Offsets are code
points, end exclusive. Repeated rows give repeated rows. Without any sample the smoothed models are equal and no span
is added. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treestat.session import written

#: The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short for their kind are dropped whole, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
VALUE_CHARS = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE_CHARS = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{CANDIDATE_CHARS},}}"
ORDINARY = "[A-Za-z0-9+/_=-]{4,}"
#: Documents whose words are the samples of ordinary identifiers.
ORDINARY_DOCS = 2000
#: Weight of a character's overall share against its counts after another one.
SMOOTHING = 30.0
#: Log of the odds against a candidate being random.
MIN_RATIO = 12.0

_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


_CHUNK = 256
_PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)


def _places(found: Column, between: Column, kind: int) -> Column:
    """Spans of matches in text order: what stands between them gives the starts."""
    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        start = acc["pos"] + F.length(F.get(between, i))
        end = start + F.length(m)
        value = F.regexp_extract(m, ASSIGN, 2) if kind == 0 else m
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:  # arrays grow by copying, so long ones are put together from short ones
        empty = F.struct(acc["pos"].alias("pos"), F.array().cast(_SPANS).alias("out"))
        some = F.sequence(c * _CHUNK, F.least(F.size(found), (c + 1) * _CHUNK) - 1)
        return F.aggregate(some, empty, step, lambda part: F.struct(part["pos"].alias("pos"), F.concat(acc["out"], F.array(part["out"])).alias("out")))

    none = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    places = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), none, chunk, lambda acc: F.flatten(acc["out"]))
    if kind == 0:
        places = F.filter(places, lambda s: F.length(s["value"]) >= VALUE_CHARS)
    return F.when(F.size(found) > 0, places).otherwise(F.array().cast(_SPANS))


def _with_spans(docs: DataFrame, text: str, base: str, more: str) -> DataFrame:
    """``docs`` with base spans and with what these leave of the candidate spans.

    Matches and what stands between them are columns of their own, so no regular expression runs twice on a text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ks = range(len(_PATTERNS))
    found, between = [f"{base}_found{k}" for k in ks], [f"{base}_between{k}" for k in ks]
    rows = docs.withColumns({found[k]: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in enumerate(_PATTERNS)})
    rows = rows.withColumns({between[k]: F.when(F.size(found[k]) > 0, F.split(t, p, -1)) for k, p in enumerate(_PATTERNS)})
    spans = [_places(F.col(found[k]), F.col(between[k]), k) for k in ks]
    rows = rows.withColumns({base: F.concat(*spans[:3]), more: spans[3]}).drop(*found, *between)
    left = F.flatten(F.transform(more, lambda c: _outside(c, F.col(base))))
    return rows.withColumn(more, F.when(F.size(more) == 0, F.col(more)).otherwise(left))


def _outside(c: Column, base: Column) -> Column:
    """The parts of a candidate span that no base span covers, without the short ones."""
    over = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    over = F.array_sort(F.transform(over, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

    def part(start: Column, end: Column) -> Column:
        value = F.substr(c["value"], start - c["start"] + 1, end - start)
        one = F.struct(c["kind"].alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        return F.when(end - start >= CANDIDATE_CHARS, F.array(one)).otherwise(F.array().cast(_SPANS))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["pos"], b["end"]).alias("pos"), F.concat(acc["out"], part(acc["pos"], b["start"])).alias("out"))

    start = F.struct(c["start"].alias("pos"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(over, start, step, lambda acc: F.concat(acc["out"], part(acc["pos"], c["end"])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base spans, and candidate spans."""
    rows = docs.select("doc_id", F.col(text).alias("t"))
    return _with_spans(rows, "t", "base", "more").select("doc_id", "base", "more")


def _transitions(words: DataFrame) -> DataFrame:
    """Counts of neighbouring characters: a, b (places in the alphabet from 1), n. At most the alphabet squared."""
    pairs = words.select(F.explode(F.regexp_extract_all("value", F.lit("(?=(..))"), F.lit(1))).alias("ab"))
    counts = pairs.groupBy("ab").agg(F.count("*").alias("n"))
    a, b = (F.instr(F.lit(ALPHABET), F.substr("ab", F.lit(k), F.lit(1))) for k in (1, 2))
    return counts.select(a.alias("a"), b.alias("b"), "n").filter("a > 0 AND b > 0")


def train(scanned: DataFrame, docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio of each transition, row by row of the alphabet; the table has a fixed size."""
    random = scanned.select(F.explode("base").alias("s")).select(F.col("s.value").alias("value"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_DOCS)
    sample = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")  # at most ORDINARY_DOCS ids
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("value")).filter(F.length("value") < 20)
    n = len(ALPHABET)
    logs = []
    for samples in (random.filter("length(value) > 1"), words.filter("length(value) > 1")):
        count = [[0] * n for _ in range(n)]
        for r in _transitions(samples).collect():
            count[r["a"] - 1][r["b"] - 1] += r["n"]
        each = [1 + sum(col) for col in zip(*count)]
        share = [SMOOTHING * x / sum(each) for x in each]  # what a rare character is followed by: the characters at large
        logs.append([[math.log((x + s) / (sum(row) + SMOOTHING)) for x, s in zip(row, share)] for row in count])
    return [r - o for row_r, row_o in zip(*logs) for r, o in zip(row_r, row_o)]


def log_ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under a trained model; transitions outside the alphabet count nothing."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    chars = F.regexp_extract_all(value, F.lit("."), F.lit(0))  # a substring would be sought from the start each time

    def step(acc: Column, char: Column) -> Column:
        b = F.instr(F.lit(ALPHABET), char)
        one = F.when((acc["a"] > 0) & (b > 0), F.get(table, (acc["a"] - 1) * len(ALPHABET) + b - 1)).otherwise(F.lit(0.0))
        return F.struct(b.alias("a"), (acc["sum"] + one).alias("sum"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def _joined(spans: Column) -> Column:
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, base and added spans of every document (arrays of kind, start, end, value)."""
    scanned = written(scan(docs, text), "secrets")
    model = train(scanned, docs, text)
    added = F.filter("more", lambda s: log_ratio(s["value"], model) >= min_ratio)
    return scanned.select("doc_id", "base", added.alias("added"))


def secret_digests(docs: DataFrame, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    found = find_secrets(docs, text, min_ratio)
    count = lambda k, c="base": F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        count(3, "added").alias("n_random"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", min_ratio: float = MIN_RATIO, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all rows stay, other columns are as they were.

    Overlapping spans give one mark. NULL texts stay NULL. The rows are written with the spans of the one scan, so no
    join is needed once the model is trained.
    """
    base, more = (_free(docs, name) for name in ("spans_base", "spans_more"))
    rows = written(_with_spans(docs, text, base, more), "secrets")
    model = train(rows.select(F.col(base).alias("base")), docs, text)
    spans = F.concat(F.col(base), F.filter(more, lambda s: log_ratio(s["value"], model) >= min_ratio))
    rows = rows.withColumn(base, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = F.when(s["start"] >= acc["pos"], F.concat(F.substr(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], fresh).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate(F.col(base), start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1)))
    rows = rows.withColumn(text, F.when(F.size(base) > 0, clean).otherwise(t))
    return rows.select(*docs.columns)


def _free(df: DataFrame, name: str) -> str:
    while any(c.startswith(name) for c in df.columns):
        name = f"_{name}"
    return name
