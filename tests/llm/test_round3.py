"""Fingerprints, token alignment and phrases against brute force; odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treestat.llm import alignment, fingerprints, phrases
from treestat.llm.queries import ORACLES
from treestat.llm.tables import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, t string, key string, h long, digest string, pid int, n long, carried string, rank long"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}." for i in range(40_000))
ODD = [None, "", " ", "  two  spaces ", "a\n b\n\n c \t d", "▁ mark", "nul\x00 byte", "<|endoftext|> <s> <0x41>", "naïve — «été»  ", "日本語 テキスト　x", "é ﻿ x ​ y", "x" * 300, "don't we'll I'M", "tab\t space", "᠎ z", LONG]


def frame(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "x", "k", 1, "d", 2, 3, "c", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklm") * r.randint(1, 3) + str(r.randint(0, vocabulary)) for _ in range(n))


# --- fingerprints ----------------------------------------------------------------------------------


def slow_walk(text):
    """The output of the walk, character by character and bit by bit."""
    w = fingerprints.walk(fingerprints.COORDINATES)
    out, j = [], 0
    for c in text:
        kind = int(w.kinds[ord(c)]) if ord(c) < 0x10000 else ord(c) % fingerprints.CLASSES
        for _ in range(int(w.stay[kind * fingerprints.PERIOD + j % fingerprints.PERIOD])):
            out.append(c)
            j += 1
    return out


def slow_digits(text):
    out = slow_walk(text)
    places = [-1 if not out else max(r for r in rec.tolist() if r < len(out)) for rec in fingerprints.walk(fingerprints.COORDINATES).records]
    chars = [-1 if p < 0 else ord(out[p]) for p in places]
    return fingerprints._digits(fingerprints._symbols(np.array([places]), np.array([chars])))[0]


def test_stay_follows_bits():
    w = fingerprints.Walk(4)
    bits = (fingerprints.mix(np.arange(1, fingerprints.CLASSES * fingerprints.PERIOD + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).reshape(fingerprints.CLASSES, -1)
    for c, j in [(0, 0), (3, 17), (255, 4095), (9, 4094)]:
        k = 0
        while not bits[c, (j + k) % fingerprints.PERIOD]:
            k += 1
        assert w.stay[c * fingerprints.PERIOD + j] == k + 1
    assert 0.48 < bits.mean() < 0.52


def test_sampled_positions_are_uniform():
    w = fingerprints.Walk(2000)
    got = w.places(np.array([1000]))[0]
    assert got.min() >= 0 and got.max() < 1000 and abs(got.mean() - 500) < 40
    same = (w.places(np.array([900]))[0] == got).mean()
    assert abs(same - 0.9) < 0.04


@pytest.mark.parametrize("abreast", [1, 48, 10_000])
def test_fingerprints_equal_slow_walk(spark, monkeypatch, abreast):
    monkeypatch.setattr(fingerprints, "ABREAST", abreast)
    texts = [t or "" for t in ODD[:-1]] + [words_of(k, 30 + k) for k in range(60)] + ["😀" * 9]
    got = fingerprints._edited([*texts, texts[0]])
    for k, t in enumerate(texts):
        nxt = [*texts, texts[0]][k + 1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        own, new, then = slow_digits(t), slow_digits(edited), slow_digits(nxt)
        assert got[0][k] == len(t) and got[1][k] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[2][k] == "".join(f"{x:x}" for x in own) and got[3][k] == "".join(f"{x:x}" for x in new)
        assert got[4][k] == pytest.approx(max(0, ((own == new).mean() - 1 / 16) * 16 / 15))
        assert got[5][k] == pytest.approx(max(0, ((own == then).mean() - 1 / 16) * 16 / 15))


def test_next_document_over_partitions(spark):
    texts = ODD + [words_of(k, 20 + 7 * k % 50) for k in range(200)]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = frame(spark, texts).repartition(5).orderBy(F.rand(3))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, b, c = fingerprints.fingerprint([t, edited, nxt])
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(a, b)) and r["near_next"] == pytest.approx(fingerprints.likeness(a, c))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "no id"), (5, "same"), (5, "same"), (5, "other text"), (9, None)], "doc_id long, text string")
    got = [tuple(r)[:2] for r in fingerprints.fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, 5), (5, 4), (5, 4), (5, 10), (9, 0)], key=repr)
    one = fingerprints.fingerprints(docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_edited"] == one[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(docs.filter("doc_id = 77")).collect() == []


def test_likeness_follows_edits(spark):
    text = words_of(1, 800)
    r = random.Random(2)
    few = text
    for _ in range(6):
        k = r.randrange(len(few))
        few = few[:k] + few[k + 1 :]
    half = text[: len(text) // 2] + words_of(9, 400)[: len(text) // 2]
    fp = fingerprints.fingerprint([text, few, half, words_of(5, 800), text])
    near = [fingerprints.likeness(fp[0], x) for x in fp]
    assert near[0] == near[4] == 1 and near[1] > 0.6 and 0.35 < near[2] < 0.7 and near[3] < 0.2


def test_near_groups(spark):
    base = [words_of(k, 120, 5000) for k in range(12)]
    texts = [*base, *(b[:200] + b[201:] for b in base), *base[:3], base[0][:210] + "zz" + base[0][210:], None, "", "short"]
    got = {r["doc_id"]: r for r in fingerprints.near_groups(frame(spark, texts)).collect()}
    assert all(got[k]["group_id"] == k and got[12 + k]["group_id"] in (k, 12 + k) for k in range(12))
    assert sum(got[12 + k]["group_id"] == k for k in range(12)) >= 11
    assert got[24]["class_id"] == 0 and got[27]["group_id"] == 0
    assert all(got[k]["kept"] for k in (28, 29, 30)) and len(got) == len(texts)


# --- token alignment -------------------------------------------------------------------------------


def slow_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = alignment._byte_chars()
    rows, count = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(chars[c] for c in a.id_to_token(k)) for k in ia]
        bb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        raw = (" " + t).encode()
        if b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append(None)
            continue
        ea, eb = {}, {}
        for ends, toks in ((ea, ba), (eb, bb)):
            at = 0
            for k, x in enumerate(toks):
                at += len(x)
                ends[at] = k
        cuts = sorted(set(ea) & set(eb))
        links = [(ia[ea[c]], ib[eb[c]]) for c in cuts]
        count.update(links)
        i = j = 0
        groups = []
        for c in cuts:
            groups.append(",".join(map(str, ia[i : ea[c] + 1])) + "|" + ",".join(map(str, ib[j : eb[c] + 1])))
            i, j = ea[c] + 1, eb[c] + 1
        rows.append((len(ia), len(ib), links, ";".join(groups)))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = r
            out.append((n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_odd_texts(spark):
    texts = ODD[:-1] + ["a  b", "a \n b", " lead", "trail ", "trail  ", "\n\n x", "x \n", "a  b", "same text", "same text", "same text", LONG[:30_000]]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.token_alignment(frame(spark, texts), A, B).collect()}
    want = slow_alignment(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert want[5] == (0, 0, 0, 0, 0, 0, "")  # the mark of a space


def test_alignment_of_documents(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.token_alignment(docs, A, B).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    assert [got[r["doc_id"]] for r in rows] == slow_alignment([r["text"] for r in rows])


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'the.,! \n\t\u00a0\u3000é日▁\u200b1")), max_size=30))
def test_units_equal_whole_texts(pair, text):
    """Both libraries over the whole text give what the units give together."""
    us = alignment.units(text)
    assert " ".join(["", *us]) == (f" {text}" if text else "")
    n_a, n_b, groups, _ = next(pair.texts([text]))
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    raw = f" {text}".encode()
    if not text or b"".join(pair.b_bytes[k] for k in b) != raw:
        assert (n_a, n_b, groups) == (0, 0, b"")
        return
    cuts = [x.split("|") for x in groups.decode().split(";")]
    assert [int(k) for x, _ in cuts for k in x.split(",")] == a and [int(k) for _, y in cuts for k in y.split(",")] == b
    assert (n_a, n_b) == (len(a), len(b))


def test_alignment_keeps_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 3)
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = alignment.token_alignment(docs, A, B).collect()
    assert sorted((r["n_a"], r["count_sum"]) for r in got) == [(0, 0), (5, 15), (5, 15), (5, 15)]
    assert alignment.token_alignment(docs.filter("doc_id > 5"), A, B).collect() == []


def test_pairs_stay_within_bound(spark):
    docs = table(spark, SF, "documents")
    rows = alignment.aligned(docs, A, B, with_groups=True)
    pairs = alignment.pair_counts(rows, A, B).collect()
    p = alignment.Pair(A, B)
    for r in pairs[:5000]:
        x, y = p.a_bytes[r["a_id"]], p.b_bytes[r["b_id"]]
        assert x.endswith(y) or y.endswith(x)
    assert len(pairs) < p.bound() < 1_000_000


# --- phrases ---------------------------------------------------------------------------------------


def slow_phrases(texts, most=3, least=10, within=50, top=2000):
    f = defaultdict(Counter)
    for lang, t in texts:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if 1 < len(p) <= most and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("most", [2, 3, 4, 5])
def test_phrases_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 3000)
    r = random.Random(most)
    texts = []
    for k in range(120):
        w = [r.choice(["The", "of", "a", "É", "x\x00y", "new", "York", "city", "zz q", "b"]) for _ in range(60)]
        texts.append((r.choice(["en", "fr", None]), "".join(x + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ; ", "\r\n", "?"]) for x in w)))
    texts += [("en", None), ("en", ""), ("fr", " .,; "), ("l\nx", "a b a b a b a b a b a b a b a b a b a b a b a b")]
    docs = frame(spark, [t for _, t in texts], [x for x, _ in texts])
    assert phrase_rows(phrases.collocations(docs, most=most, top=40)) == slow_phrases(texts, most, top=40)


def test_phrases_of_documents(spark):
    docs = table(spark, SF, "documents")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op13_phrases']})").fetchall()
    assert phrase_rows(phrases.collocations(docs)) == sorted(want) and want


def test_phrases_without_rows(spark):
    assert phrases.collocations(frame(spark, [None, "", "one two three"])).collect() == []
    assert phrases.collocations(frame(spark, ["x"]).filter("doc_id > 9")).collect() == []


def test_score_passes_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 5 * 10**12), ("en", "b", 1, 5 * 10**12)], "lang string, phrase string, words int, n long")
    cand = spark.createDataFrame([("en", "a b", 2, 4 * 10**12)], "lang string, phrase string, words int, a long")
    row = phrases._cuts(cand, counts, 3).select(F.expr("CAST((CAST(a AS DECIMAL(38, 0)) * a * 1000000) DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)").alias("s")).first()
    assert row["s"] == 640_000
