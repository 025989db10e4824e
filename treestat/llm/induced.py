"""External induced sorting of suffixes with common-prefix lengths.

Suffix tuples (position, common prefix with the one before) wait in a priority queue by their first character and
arrival. Popping the queue in order induces the suffixes that begin one place earlier: first the descending (L) ones
from the sorted S* suffixes, upwards, then the ascending (S) ones from the L ones, downwards. An induced suffix's
common prefix is one more than the least common prefix passed since the last one of its queue bucket. The S* suffixes
themselves are sorted by a first induction, which orders their substrings, and by the order of the string of their
names, whose ranks are doubled as far as ``cap`` characters.

Work is done a bucket at a time in numpy. Queue buckets beyond ``memory`` bytes wait in files; the text, its types,
hashes and names are held in memory whole, and positions are 32-bit, so a shard must fit there and stay below 2 GiB; the order is exact up to ``cap`` characters, and common prefixes are capped there.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


class BucketQueue:
    """A priority queue of suffix tuples by (bucket, arrival), on disk beyond ``memory`` bytes."""

    def __init__(self, buckets: int, memory: int) -> None:
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.files: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
        self.memory, self.size, self.dir, self.made = memory, 0, None, 0

    def push(self, bucket: int, tuples: np.ndarray) -> None:
        """``tuples``: positions in the first row, common prefixes in the second."""
        self.held[bucket].append(tuples)
        self.size += tuples.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.dir is None:
            self.dir = tempfile.TemporaryDirectory(prefix="queue-")
        for b, parts in enumerate(self.held):
            if parts:
                self.made += 1
                path = os.path.join(self.dir.name, str(self.made))
                both = np.concatenate(parts, axis=1)
                both.tofile(path)
                self.files[b].append((path, both.shape[1]))
                self.held[b] = []
        self.size = 0

    def pop(self, bucket: int) -> Iterator[np.ndarray]:
        """All tuples of a bucket in order of arrival, in parts; what is pushed meanwhile comes later."""
        while self.files[bucket] or self.held[bucket]:
            if self.files[bucket]:
                path, n = self.files[bucket].pop(0)
                yield np.fromfile(path, np.int32).reshape(2, n)
                os.unlink(path)
            else:
                parts, self.held[bucket] = self.held[bucket], []
                self.size -= sum(p.nbytes for p in parts)
                yield np.concatenate(parts, axis=1)

    def close(self) -> None:
        if self.dir is not None:
            self.dir.cleanup()


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the next one); the last one is S."""
    up = np.empty(len(text), bool)
    up[-1] = True
    diff = text[1:] != text[:-1]
    nxt = np.where(diff, np.arange(len(text) - 1), len(text) - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    inside = nxt < len(text) - 1
    up[:-1] = np.where(inside, text[nxt] < text[np.minimum(nxt + 1, len(text) - 1)], True)
    return up


class _Induction:
    """One run of both inductions over a text."""

    def __init__(self, text: np.ndarray, up: np.ndarray, cap: int, memory: int) -> None:
        self.text, self.up, self.cap, self.memory = text, up, cap, memory
        self.sigma = int(text.max()) + 1
        change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
        self.run_end = change  # last place of each run of one character

    def _run(self, pos: int) -> int:
        return int(self.run_end[np.searchsorted(self.run_end, pos)]) - pos + 1

    def _induce(self, queue: BucketQueue, least: np.ndarray, part: np.ndarray, want_up: bool) -> None:
        """Push the suffixes one place before those of ``part``, if they are of the wanted type."""
        before = part[0] - 1
        ok = np.flatnonzero(before >= 0)
        ok = ok[self.up[before[ok]] == want_up]
        if not len(ok):
            np.minimum(least, part[1].min(), out=least)
            return
        chars = self.text[before[ok]]
        order = np.argsort(chars, kind="stable")
        ok, chars = ok[order], chars[order]
        cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        seen = np.zeros(self.sigma, bool)
        lcps = part[1]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ok)]):
            at, c = ok[a:b], int(chars[a])
            seen[c] = True
            mins = np.minimum.reduceat(lcps[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            mins[0] = min(int(mins[0]), int(least[c]))
            queue.push(c, np.stack([before[at], np.minimum(mins + 1, self.cap)]).astype(np.int32))
            least[c] = lcps[at[-1] + 1 :].min() if at[-1] + 1 < len(lcps) else self.cap
        np.minimum(least, np.where(seen, self.cap, lcps.min()), out=least)

    def sorted(self, stars: list[np.ndarray]) -> Iterator[np.ndarray]:
        """All suffixes in descending order as tuples (position, common prefix with the one above), by parts.

        ``stars`` has the sorted S* tuples of each bucket.
        """
        queue, kept = BucketQueue(self.sigma, self.memory), BucketQueue(self.sigma, self.memory)
        least = np.full(self.sigma, -1)  # nothing inserted yet: common prefix 0
        for c in range(self.sigma):
            last = None
            for part in queue.pop(c):
                if last is None:
                    part[1, 0] = 0
                last = int(part[0, -1])
                self._induce(queue, least, part, False)
                kept.push(c, part)
            if len(star := stars[c][0]):
                star = stars[c].copy()
                star[1, 0] = 0 if last is None else min(self._run(last), self._run(int(star[0, 0])), self.cap)
                self._induce(queue, least, star, False)
        queue.close()
        queue = BucketQueue(self.sigma, self.memory)
        least = np.full(self.sigma, -1)
        queue.push(int(self.text[-1]), np.array([[len(self.text) - 1], [0]], np.int32))
        for c in range(self.sigma - 1, -1, -1):
            last = None
            for part in queue.pop(c):
                if last is None:
                    part[1, 0] = 0
                last = int(part[0, -1])
                self._induce(queue, least, part, True)
                yield part
            descending = list(kept.pop(c))
            link = None  # an L tuple has the common prefix with the one below; here it belongs to the one above
            for k in range(len(descending) - 1, -1, -1):
                part = descending[k][:, ::-1]
                lcp = np.empty(part.shape[1], np.int32)
                lcp[1:] = part[1, :-1]
                if link is None:
                    lcp[0] = 0 if last is None else min(self._run(last), self._run(int(part[0, 0])), self.cap)
                else:
                    lcp[0] = link
                link = int(part[1, -1])
                part = np.stack([part[0], lcp])
                self._induce(queue, least, part, True)
                yield part
        queue.close()
        kept.close()


def _prefix_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of characters times powers, and the powers; the step is odd, so powers have inverses."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _STEP, np.uint64)]))
    mixed = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:-1])]), power


def suffixes(text: np.ndarray, cap: int, memory: int = 64 << 20) -> Iterator[np.ndarray]:
    """(position, common prefix with the suffix above) of all suffixes in descending order, exact up to ``cap``.

    ``text`` has small non-negative integers and ends with its only 0.
    """
    up = types(text)
    star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    work = _Induction(text, up, cap, memory)
    if not len(star):
        star = np.array([len(text) - 1])

    def by_bucket(pos: np.ndarray, lcp: np.ndarray) -> list[np.ndarray]:
        cut = np.searchsorted(text[pos], np.arange(work.sigma + 1))
        return [np.stack([pos[a:b], lcp[a:b]]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]

    # a first induction from S* suffixes in any order of their first character sorts their substrings
    start = star[np.argsort(text[star], kind="stable")]
    is_star = np.zeros(len(text), bool)
    is_star[star] = True
    found = [part[0][is_star[part[0]]] for part in work.sorted(by_bucket(start, np.zeros(len(start), np.int64)))]
    order = np.concatenate(found)[::-1].astype(np.int64)
    del found
    # names: equal substrings (up to and with the next S* place) get one
    nxt = np.append(star[1:] + 1, len(text))
    length = np.zeros(len(text), np.int64)
    length[star] = np.minimum(nxt, len(text)) - star
    sums, power = _prefix_hashes(text)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    la = length[a]
    same &= (sums[a + la] - sums[a]) * power[np.maximum(b - a, 0)] == (sums[np.minimum(b + la, len(text))] - sums[b]) * power[np.maximum(a - b, 0)]
    name = np.concatenate([[0], np.cumsum(~same)])
    rank = np.empty(len(star), np.int64)
    rank[np.searchsorted(star, order)] = name
    # ranks of the string of names, doubled until they differ or reach over the cap
    h = 1
    while h < cap and rank.max() < len(rank) - 1:
        key = (rank + 1) * (len(rank) + 2)
        key[:-h] += rank[h:] + 1
        if len(rank) <= h:
            break
        _, rank = np.unique(key, return_inverse=True)
        h *= 2
    order = star[np.argsort(rank, kind="stable")]
    # their common prefixes, by bisection over equal hashes
    a, b = order[:-1], order[1:]
    lo, hi = np.zeros(len(a), np.int64), np.minimum(cap, len(text) - np.maximum(a, b))
    while (wide := np.flatnonzero(lo < hi)).size:
        m = (lo[wide] + hi[wide] + 1) // 2
        x, y = a[wide], b[wide]
        eq = (sums[x + m] - sums[x]) * power[np.maximum(y - x, 0)] == (sums[y + m] - sums[y]) * power[np.maximum(x - y, 0)]
        lo[wide], hi[wide] = np.where(eq, m, lo[wide]), np.where(eq, hi[wide], m - 1)
    yield from work.sorted(by_bucket(order, np.concatenate([[0], lo])))


def repeated(text: np.ndarray, size: int, memory: int = 64 << 20) -> np.ndarray:
    """Whether the ``size`` characters from each place occur at another place, too."""
    out = np.zeros(len(text), bool)
    last = -1
    for pos, lcp in suffixes(text, size, memory):
        hit = lcp >= size
        out[pos[hit]] = True
        above = np.concatenate([[last], pos[:-1]])
        out[above[hit]] = True
        last = int(pos[-1])
    return out
