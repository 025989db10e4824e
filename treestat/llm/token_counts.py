"""Exact token counts at every prefix of a text, for a sentencepiece BPE model, by prefix dynamic programming.

The encoding of any prefix ends in exactly one token. A token ``t`` ending at ``i`` is that last token when ``t``
encodes to itself and the token before it, the last one of the prefix before ``t``, stays apart from ``t`` when the
two are encoded together. So one pass over a word gives last token and count at every prefix, and a question about
truncation or a budget is a look-up, not a new encoding. Pieces never span a change between white space, letters and
other characters (checked against the vocabulary on loading), so the pass works word by word; counts of words met before
are kept in a table of bounded size in each worker.

Defined cases: NULL or empty text has 0 tokens. No begin, end or special tokens; no truncation or padding; special
strings in a text are ordinary text; characters outside the vocabulary count their UTF-8 bytes. Whole texts are
counted however long. Other columns, also such with clashing names, are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treestat.llm.tables import add_columns, held

MEMO_WORDS = 600_000
SLICE_CHARS = 2_000_000
#: Longer words are counted but not kept.
MEMO_CHARS = 40
SPACE = "▁"
def _letter_ranges() -> str:
    """A character class of all letters, and of everything beyond the basic plane."""
    out, start = [], None
    for i in range(0x10001):
        letter = i < 0x10000 and chr(i).isalpha()
        if letter and start is None:
            start = i
        elif not letter and start is not None:
            out.append(f"{chr(start)}-{chr(i - 1)}")
            start = None
    return "".join(out) + "\U00010000-\U0010ffff"


_LETTERS = _letter_ranges()
_WORDS = re.compile(f"{SPACE}*(?:[{_LETTERS}]+|[^{_LETTERS}{SPACE}]+)|{SPACE}+")


_PAIR_BITS = 21
_STEP = 0x9E3779B97F4A7C15


def _mixed(codes):
    """A 64-bit value of each code point."""
    with np.errstate(over="ignore"):
        x = codes * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


class PrefixCounter(dict):
    """word -> token counts of its prefixes (bytes where they fit, else a list), filled on demand."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        probe = " a  ﬁ 　é\t\n\x00"
        if sp.normalize(probe) != self.normal(probe) or sp.encode_as_pieces("\na") != [SPACE, "<0x0A>", "a"]:
            raise ValueError("the model's normaliser is not the identity with a dummy prefix, or it has no byte fallback")
        if bad := [p for p in self.score if not _WORDS.fullmatch(p)]:
            raise ValueError(f"pieces span a boundary between words: {bad[:5]}")
        self.sp = sp
        #: Prefixes of pieces -> whether they are a piece that encodes to itself; others never end a prefix.
        self.own: dict[str, bool] = {}
        for p in self.score:
            for k in range(1, len(p)):
                self.own.setdefault(p[:k], False)
        for p in self.score:
            self.own[p] = SPACE * 2 not in p and self.pieces(p) == [p]
        self.runs: list[int] = []
        self._tables()
        #: (last token, next token) -> whether they stay apart when encoded together.
        self.apart: dict[tuple[str, str], bool] = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces of ``text`` inside a text: a line feed, which no piece has, keeps the dummy prefix away."""
        return self.sp.encode_as_pieces("\n" + text)[2:]

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """Plain BPE by priority: best score first, leftmost among equals."""
        parts, nxt, prev = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        score = self.score
        heap = [(-score[p], i, len(p)) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if parts[i] else -1
            if j < 0 or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (p := parts[a] + parts[b]) in score:
                    heapq.heappush(heap, (-score[p], a, len(p)))
        return [p for p in parts if p]

    def _word(self, word: str) -> tuple[list[int], str]:
        """Counts after each character, and the first token of the whole word."""
        n, own, apart, pieces = len(word), self.own.get, self.apart, self.pieces
        if len(apart) > 500_000:
            apart.clear()
        count, last, first = [0] * (n + 1), [""] * (n + 1), [""] * (n + 1)
        for j in range(n):
            before = last[j]
            for i in range(j + 1, n + 1):
                t = word[j:i]
                if (whole := own(t)) is None:
                    break
                if whole and not first[i]:
                    if before:
                        key = (before, t)
                        if (ok := apart.get(key)) is None:
                            ok = apart[key] = pieces(before + t) == [before, t]
                        if not ok:
                            continue
                    count[i], last[i], first[i] = count[j] + 1, t, first[j] or t
            if not first[j + 1]:  # not in the vocabulary: its bytes, which never merge
                c = word[j]
                count[j + 1], first[j + 1] = count[j] + len(c.encode("utf-8", "surrogatepass")), first[j] or c
        return count[1:], first[n]

    # The same pass for many words at once: substrings are looked up by a polynomial hash, the pass goes by end position.

    def _tables(self) -> None:
        self.names = [p for p, whole in self.own.items() if whole]
        self.longest = max(map(len, self.names))
        hashes = np.array([self._hash(p) for p in self.names], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], order.astype(np.int64) + 1
        self.seen_hash = np.zeros(1 << 20, bool)
        self.seen_hash[hashes >> np.uint64(44)] = True
        # a table of fixed size, by the hash of the pair: what does not fit is asked again
        self.pair_key, self.pair_apart = np.full(1 << _PAIR_BITS, -1, np.int64), np.zeros(1 << _PAIR_BITS, bool)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _STEP + int(_mixed(np.uint64(ord(c))))) & 0xFFFFFFFFFFFFFFFF
        return h

    def _pairs_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens stay apart, by id; 0 on the left (start of a word, bytes) always does."""
        base = len(self.names) + 1
        keys = left * base + right
        slot = (keys.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        known = (self.pair_key[slot] == keys) | (left == 0)
        apart = (left == 0) | self.pair_apart[slot]
        if not known.all():
            miss = np.flatnonzero(~known)
            new, back = np.unique(keys[miss], return_inverse=True)
            names = self.names
            found = np.array([self.pieces(a + b) == [a, b] for a, b in ((names[k // base - 1], names[k % base - 1]) for k in new.tolist())], bool)
            apart[miss] = found[back]
            self.pair_key[slot[miss]], self.pair_apart[slot[miss]] = keys[miss], apart[miss]
        return apart

    def _many(self, words: list[str]) -> list[bytes]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        start = np.repeat(ends - lens, lens)
        end = np.repeat(ends, lens)
        mixed = _mixed(chars.astype(np.uint64))
        roll = np.zeros(n, np.uint64)
        at, ids, size = [], [], []
        for k in range(1, self.longest + 1):  # hash of the substring of k characters that begins at each place
            m = n - k + 1
            if m <= 0:
                break
            roll = roll[:m] * np.uint64(_STEP) + mixed[k - 1 :]
            p = np.flatnonzero(self.seen_hash[roll >> np.uint64(44)] & (end[:m] >= np.arange(k, m + k)))
            h = roll[p]
            f = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ok = self.hashes[f] == h
            at.append(p[ok])
            ids.append(self.hash_ids[f[ok]])
            size.append(np.full(int(ok.sum()), k))
        at, ids, size = np.concatenate(at), np.concatenate(ids), np.concatenate(size)
        offset = at + size - start[at]
        order = np.argsort(offset, kind="stable")
        at, ids, size = at[order], ids[order], size[order]
        bounds = np.searchsorted(offset[order], np.arange(1, int(lens.max()) + 2))
        count, last, done = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, bool)
        width = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        # count[i], last[i]: of the prefix that ends with character i - 1; a word's own start counts as nothing before
        for r in range(1, int(lens.max()) + 1):
            a, t, k = (x[bounds[r - 1] : bounds[r]] for x in (at, ids, size))
            first = start[a] == a
            left = np.where(first, 0, last[a])
            ok = self._pairs_apart(left, t)
            a, t, k = a[ok], t[ok], k[ok]
            count[a + k] = np.where(start[a] == a, 0, count[a]) + 1
            last[a + k] = t
            done[a + k - 1] = True
            rest = (ends - lens + r - 1)[lens >= r]
            rest = rest[~done[rest]]
            count[rest + 1] = np.where(start[rest] == rest, 0, count[rest]) + width[rest]
            last[rest + 1] = 0
        flat = count[1:].astype(np.uint8).tobytes()
        return [flat[b - x : b] for b, x in zip(ends.tolist(), lens.tolist())]

    def learn(self, words: Iterable[str]) -> None:
        """Fill the table for words not met before, many at once."""
        new = [w for w in words if w not in self and len(w) <= MEMO_CHARS and w[:2] != SPACE * 2]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.update(zip(part, self._many(part)))

    def totals(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text, some million characters at a time."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            split = [_WORDS.findall(self.normal(t)) for t in texts[at:end]]
            self.learn(set(chain.from_iterable(split)))
            for ws in split:
                yield sum([self[w][-1] for w in ws])
            at = end

    def _run(self, k: int) -> int:
        """Tokens of a run of k spaces. Merging goes from the left, so the first token of a long run is settled early."""
        if not self.runs:
            self.runs = [len(self.merged(SPACE * i)) for i in range(129)]
        step = max(map(len, self.score))
        if k > 128 and all(self.runs[i] == self.runs[i - step] + 1 for i in range(64, 129)):
            blocks = (k - 113) // step
            return self.runs[k - blocks * step] + blocks
        return self.runs[k] if k <= 128 else len(self.merged(SPACE * k))

    def counts(self, word: str) -> list[int]:
        body = word.lstrip(SPACE)
        k = len(word) - len(body)
        if k < 2 and body:
            return self._word(word)[0]
        runs = [self._run(i) for i in range(1, k + 1)]
        if not body:
            return runs
        own, out = SPACE + body, runs
        inner = self._word(own)[0]
        for i in range(2, len(own) + 1):  # spaces merge after everything else; the last one may belong to the word
            alone = self._word(own[:i])[1] == SPACE
            out.append(inner[i - 1] - 1 + runs[k - 1] if alone else inner[i - 1] + runs[k - 2])
        return out

    def __missing__(self, word: str):
        c = self.counts(word)
        if c[-1] < 256 and max(c) < 256:
            c = bytes(c)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = c
        return c

    def total(self, text: str) -> int:
        return sum([self[w][-1] for w in _WORDS.findall(self.normal(text))])

    def prefixes(self, text: str) -> list[int]:
        """Counts of text[:0], text[:1], ... and the whole text."""
        out, base = [], 0
        for w in _WORDS.findall(self.normal(text)):
            c = self[w]
            out += [base + x for x in c]
            base += c[-1]
        return [0, *out[1:]]

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        words = _WORDS.findall(self.normal(text))
        kept = [self[w] for w in words]
        base, end = sum([c[-1] for c in kept]), sum(map(len, words))
        for c in reversed(kept):
            base, end = base - c[-1], end - len(c)
            for i in range(len(c) - 1, -1, -1):
                if base + c[i] <= budget and end + i > 0:
                    return end + i
        return 0


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a model."""
    return held(("counter", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: characters of the longest prefix within ``limit`` tokens."""

    def run(texts: list[str]) -> list[list]:
        c = counter(path)
        n = list(c.totals(texts))
        return [n, [k > limit for k in n], [len(t) if k <= limit else c.longest_prefix(t, limit) for t, k in zip(texts, n)]]

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", t.alias("t"), F.octet_length(t).cast("long").alias("n_bytes"))
    return add_columns(rows, ["doc_id", "n_bytes"], ["t"], run, {"n_tokens": "long", "over_limit": "boolean", "fit_chars": "long"})


def prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``prefix_tokens`` array<int>: the exact count at every prefix, 0 first. Replaces such a column."""
    rows = docs.drop("prefix_tokens")
    return add_columns(rows, rows.columns, [text], lambda texts: [[counter(path).prefixes(t or "") for t in texts]], {"prefix_tokens": "array<int>"})


def tokens_at(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters."""
    return F.get(prefix_tokens, F.lit(chars) if isinstance(chars, int) else chars)


def chars_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix within ``budget`` tokens."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    at = F.filter(F.sequence(F.lit(0), F.size(prefix_tokens) - 1), lambda i: F.get(prefix_tokens, i) <= b)
    return F.coalesce(F.array_max(at), F.lit(0))
