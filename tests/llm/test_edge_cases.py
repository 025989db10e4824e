"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from treestat.llm import byte_bpe, decontaminate, html_text, minhash, neighbours, quality, secrets, suffix_dedup, token_counts, toxicity

RANKS, PATTERN, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
BIG = 9_007_199_254_740_993  # an id that no double holds
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, key long, v long, u long, bands string, rid long, spans_base string, label string, root long"
LABELS = "doc_id long, quality int, toxic int, text string, t string"


def rows(*pairs):
    return [(i, t, None, "s", None if t is None else len(t), "x", 1, 2, 3, "b", 4, "c", "l", 5) for i, t in pairs]


@pytest.fixture(scope="module")
def docs(spark):
    copies = [(100 + k, "one two three four five six seven eight nine ten") for k in range(3)]
    return spark.createDataFrame(rows((1, None), (2, ""), (BIG, LONG), (4, "   \n "), (None, "no id here"), (6, "short"), (6, "short"), *copies), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, None, "a", "b"), (None, 1, 0, "a", "b"), (6, 1, 0, "a", "b"), (BIG, 0, 1, "a", "b"), (BIG, 1, 0, "a", "b")], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "one two three four five six seven eight nine ten", "x"), (4, "--", "x")], "item_id long, text string, doc_id string")


CASES = {
    "leaks": lambda d, lab, it: decontaminate.leaks(d, it),
    "leak_filter": lambda d, lab, it: decontaminate.keep_clean(d, it),
    "severity": lambda d, lab, it: toxicity.severity(d, lab),
    "toxic_filter": lambda d, lab, it: toxicity.keep_clean(d, lab),
    "counts": lambda d, lab, it: token_counts.token_counts(d, PIECES),
    "groups": lambda d, lab, it: minhash.groups(d),
    "first": lambda d, lab, it: minhash.keep_first(d),
    "digests": lambda d, lab, it: byte_bpe.digests(d, RANKS, PATTERN),
    "secrets": lambda d, lab, it: secrets.secret_digests(d),
    "redact": lambda d, lab, it: secrets.redact(d),
    "quality": lambda d, lab, it: quality.quality_scores(d, lab),
    "removal": lambda d, lab, it: suffix_dedup.removal_digests(d),
}
FILTERS = {"leaks", "leak_filter", "toxic_filter", "first"}


@pytest.mark.parametrize("name", CASES)
def test_rows(docs, labels, items, name):
    out = CASES[name](docs, labels, items).collect()
    if name not in FILTERS | {"groups"}:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    if name in ("toxic_filter", "leak_filter", "first", "redact"):
        given = {str(r) for r in docs.collect()}
        assert {str(r) for r in out} <= given
    if name == "groups":
        got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in out}
        assert got == {1: (1, True), 2: (2, True), BIG: (BIG, True), 4: (4, True), 6: (6, True), 100: (100, True), 101: (100, False), 102: (100, False)}
    if name == "first":
        assert sorted(str(r["doc_id"]) for r in out) == sorted(map(str, [1, 2, BIG, 4, None, 6, 100]))
    if name == "leaks":
        assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in out) == [(100 + k, None, 1.0) for k in range(3)]
    by = {r["doc_id"]: r for r in out if "doc_id" in out[0]}
    empty = hashlib.sha256(b"").hexdigest()
    if name == "counts":
        import sentencepiece

        n = len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(LONG))
        assert [tuple(by[i])[:4] for i in (1, 2, BIG)] == [(1, 0, 0, False), (2, 0, 0, False), (BIG, len(LONG), n, True)]
    if name == "digests":
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
        assert [tuple(by[i]) for i in (1, 2)] == [(1, 0, empty, empty), (2, 0, empty, empty)]
        assert by[BIG]["n_tokens"] == len(enc.encode_ordinary(LONG)) and by[BIG]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
        assert len({tuple(r)[1:] for r in out if r["doc_id"] in (100, 101, 102)}) == 1
    if name == "secrets":
        assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (0, 0, 0, empty, "") for r in out)
    if name in ("severity", "quality"):
        value = "severity" if name == "severity" else "score"
        assert all(r[value] is not None and 0 <= r[value] <= (3 if name == "severity" else 1) for r in out)
        assert by[1][value] == by[2][value] and by[100][value] == by[101][value] == by[102][value]
        assert len({r[value] for r in out if r["doc_id"] == 6}) == 1
    if name == "quality":
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    if name == "toxic_filter":
        bad = {r["doc_id"] for r in toxicity.severity(docs, labels).filter("toxic").collect()}
        assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()} - bad
    if name == "redact":
        assert sorted(str(r) for r in out) == sorted(str(r) for r in docs.collect())
    if name == "removal":
        by = {r["doc_id"]: r for r in out}
        assert by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        assert by[BIG]["n_removed"] > 0 and by[BIG]["n_bytes"] == len(LONG)


@pytest.mark.parametrize("name", CASES)
def test_empty(spark, none, name):
    lab = spark.createDataFrame([], LABELS)
    it = spark.createDataFrame([], "item_id long, text string")
    assert CASES[name](none, lab, it).collect() == []


@pytest.mark.parametrize("name", ["severity", "quality", "leaks"])
def test_without_labels(spark, docs, name):
    lab = spark.createDataFrame([], LABELS)
    out = CASES[name](docs, lab, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(out) == (0 if name == "leaks" else docs.count())


def test_pages(spark):
    rows = [(1, None, None, 1), (None, "u", "", 2), (BIG, "u", "<p>Text &amp; more.", 3), (4, "u", "<article>" + "<p>a b c.</p>" * 20_000 + "</article>", 4), (4, "u", "<script>x", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, h int")
    got = sorted(((str(r["page_id"]), r["text"][:14], r["n_chars"]) for r in html_text.main_text(df).collect()))
    assert got == sorted([("1", "", 0), ("None", "", 0), (str(BIG), "Text & more.", 12), ("4", "a b c.\n\na b c.", 8 * 20_000 - 2), ("4", "", 0)])
    assert html_text.main_text(df.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1)]
    rows += [(10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, None], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, x string, v long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.links(df).collect()}
    alone = {k: (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, False), **alone}
    assert neighbours.links(df.limit(0)).collect() == []


def test_general_interfaces(spark):
    df = spark.createDataFrame([(1, "Hello  world, naïve\nété <s>", "old"), (2, None, "old")], "doc_id long, text string, token_ids string")
    coded = byte_bpe.encode(df, RANKS, PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(coded, RANKS, PATTERN).collect()}
    assert back == {1: "Hello  world, naïve\nété <s>", 2: ""}
    p = token_counts.prefix_counts(df, PIECES).select("*", token_counts.chars_within(F.col("prefix_tokens"), 3).alias("fit"), token_counts.tokens_at(F.col("prefix_tokens"), 5).alias("five"))
    got = {r["doc_id"]: r for r in p.collect()}
    assert len(got[1]["prefix_tokens"]) == 28 and got[1]["prefix_tokens"][got[1]["fit"]] <= 3 and got[2]["fit"] == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.kept_bytes(df.unionAll(df), size=10).collect()}
    assert kept == {1: b"", 2: b""} or kept[2] == b""
