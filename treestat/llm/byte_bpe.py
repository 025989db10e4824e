"""Byte-level BPE encoding and decoding by recursive SQL.

Each Spark task runs DuckDB over the words of its own rows. A word's bytes are token-position rows; a recursive
query joins neighbouring tokens to the merge table and contracts each word's leftmost pair of minimum rank, for all
words at once, until none is left. Decoding joins ids to the vocabulary and concatenates the bytes in position order.

A step costs as much as the words it works on and a word takes a step for each merge, so words over ``LONG_WORD`` bytes
(runs of letters or spaces that no prose has) are contracted by a priority queue of their pairs instead, in the same
order and with the same result, in near linear time.

Words repeat, so a worker keeps the tokens of words that it has met in a table of bounded size and sends only new
words through SQL. Nothing else is kept between rows: memory is bounded by one slice of texts plus that table.

Defined cases: a NULL or empty text has no tokens (n_tokens 0, digests of no bytes). Text is encoded whole, special
strings in it as ordinary text. Other columns of the input, also such with clashing names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treestat.llm.tables import add_columns, held

#: Words kept by a worker; about 300 bytes each.
MEMO_WORDS = 250_000
#: Characters of text in a slice, and new words in one recursive query.
SLICE_CHARS, QUERY_WORDS = 2_000_000, 40_000
#: Bytes of the longest word that goes through the recursive query, and rows that one query may leave.
LONG_WORD, QUERY_ROWS = 256, 4_000_000

_CONTRACT = """
WITH RECURSIVE state(step, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)),
    best AS (
      SELECT word, min(made_at) AS made_at, arg_min(next_pos, made_at) AS gone
      FROM (SELECT p.word, p.next_pos, (m.made::BIGINT << 32) + p.pos AS made_at FROM pairs p JOIN merges m ON m.a = p.tok AND m.b = p.next_tok) GROUP BY word)
    SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = (b.made_at & 4294967295) THEN (b.made_at >> 32)::INTEGER ELSE s.tok END
    FROM state s JOIN best b USING (word) WHERE s.pos <> b.gone)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) GROUP BY word
"""

_DECODE = "SELECT word, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """A vocabulary loaded into DuckDB with its merge table."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.words = regex.compile(pattern)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": "", "preserve_insertion_order": False})
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        splits = [(self.ranks[w[:k]], self.ranks[w[k:]], r) for w, r in self.ranks.items() for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        a, b, made = zip(*splits) if splits else ((), (), ())
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "made": pa.array(made, pa.int32())})
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [w.hex() for w in self.ranks]})
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _run(self, sql: str, **tables):
        for name, t in tables.items():
            self.db.register(name, t)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and their numbers. A word that is one token needs no contraction."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = np.ones(len(words), np.int64)
        rows, flat = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        for k in np.flatnonzero((whole < 0) & (size > LONG_WORD)).tolist():
            flat.append(np.array(self.long_word(words[k]), np.int32))
            n[k] = len(flat[-1])
            rows.append(np.full(n[k], k))
        todo = np.flatnonzero((whole < 0) & (size <= LONG_WORD))
        if len(todo):
            word, sizes, made = self._contracted(words, todo)
            n[word] = sizes
            rows.append(np.repeat(word, sizes))
            flat.append(made)
        return np.concatenate(flat).astype(np.int32)[np.argsort(np.concatenate(rows), kind="stable")], n

    def _contracted(self, words: list[bytes], todo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen words: places in any order, numbers of tokens, tokens one word after the other."""
        raw = [words[k] for k in todo.tolist()]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lens)
        toks = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        pos = np.arange(len(toks)) - np.repeat(ends - lens, lens)
        start = pa.table({"word": np.repeat(todo.astype(np.int32), lens), "pos": pos.astype(np.int32), "tok": toks})
        got = self._run(_CONTRACT, start=start).combine_chunks()
        lists = got["ids"].combine_chunks() if isinstance(got["ids"], pa.ChunkedArray) else got["ids"]
        made = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        return got["word"].to_numpy(), sizes, made

    def long_word(self, word: bytes) -> list[int]:
        """Ids of one word: its leftmost pair of minimum rank is contracted until none is left."""
        n, rank = len(word), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, end = heappop(queue)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue  # one of the two has been contracted since
            alive[after[i]] = 0
            after[i], before[end] = end, i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank(word[k : after[after[k]]])) is not None:
                    heappush(queue, (r, k, after[after[k]]))
        return [self.ranks[word[i : after[i]]] for i in range(n) if alive[i]]

    def decode_ids(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids, by an ordered aggregation over token rows."""
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        rows = pa.table({"word": np.repeat(np.arange(len(lens), dtype=np.int32), lens), "pos": pos.astype(np.int32), "id": flat.astype(np.int32)})
        out = [b""] * len(lens)
        got = self._run(_DECODE, tokens=rows)
        for k, x in zip(got["word"].to_pylist(), got["hex"].to_pylist()):
            out[k] = bytes.fromhex(x)
        return out

    def _learn(self, words: set[str]) -> None:
        """Put the words' tokens and bytes in the memo; when it is full only these words stay."""
        todo = [w for w in words if w not in self.memo]
        if len(self.memo) + len(todo) > MEMO_WORDS:
            self.memo = {w: self.memo[w] for w in words if w in self.memo}
        rows = np.cumsum([0, *(min(len(w), LONG_WORD) ** 2 for w in todo)])  # at least what the steps of a word leave
        at = 0
        while at < len(todo):
            end = min(at + QUERY_WORDS, max(at + 1, int(np.searchsorted(rows, rows[at] + QUERY_ROWS, "right")) - 1))
            part, at = todo[at:end], end
            flat, lens = self.encode_words([w.encode("utf-8", "surrogatepass") for w in part])
            back = self.decode_ids(flat, lens)
            raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lens)).tolist()
            self.memo.update((w, (raw[a:b], x)) for w, a, b, x in zip(part, [0, *ends], ends, back))

    def round_trip(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of each text, in slices of bounded size."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            if end == at + 1 and chars > SLICE_CHARS:  # a very long text: its words in pieces, so only its ids are held whole
                yield self._long(texts[at])
            else:
                split = [self.words.findall(t) for t in texts[at:end]]
                self._learn(set(chain.from_iterable(split)))
                memo = self.memo
                for ws in split:
                    pairs = [memo[w] for w in ws]
                    yield b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
            at = end

    def _long(self, text: str) -> tuple[bytes, bytes]:
        ids, back, piece, chars = [], [], [], 0

        def flush() -> None:
            self._learn(set(piece))
            ids.append(b"".join(self.memo[w][0] for w in piece))
            back.append(b"".join(self.memo[w][1] for w in piece))

        for m in self.words.finditer(text):
            piece.append(m[0])
            chars += len(m[0])
            if chars > SLICE_CHARS:
                flush()
                piece, chars = [], 0
        flush()
        return b"".join(ids), b"".join(back)


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` array<int> of the whole text. Replaces a column of that name."""
    rows = docs.drop("token_ids")

    def run(texts: list[str]) -> list[list]:
        return [[np.frombuffer(i, "<u4").astype("i4") for i, _ in codec(path, pattern).round_trip([t or "" for t in texts])]]

    return add_columns(rows, rows.columns, [text], run, {"token_ids": "array<int>"})


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded`` binary of the id lists; NULL lists give no bytes."""
    rows = rows.drop("decoded")

    def run(lists: list) -> list[list]:
        lists = [x or [] for x in lists]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        return [codec(path, pattern).decode_ids(np.fromiter(chain.from_iterable(lists), np.int64, int(lens.sum())), lens)]

    return add_columns(rows, rows.columns, [ids], run, {"decoded": "binary"})


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the decoded bytes."""

    def run(texts: list[str]) -> list[list]:
        made = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(b).hexdigest()) for i, b in codec(path, pattern).round_trip(texts)]
        return [list(x) for x in zip(*made)] if made else [[], [], []]

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    return add_columns(rows, ["doc_id"], ["t"], run, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
