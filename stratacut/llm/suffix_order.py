"""Suffixes in order with their common prefixes, by induced sorting through queues that spill to disk.

Suffixes are S (smaller than the next one) or L; an S after an L is a seed. Seeds are brought into order by a first, rough
induction that sorts them up to the next seed, by naming equal stretches and by sorting the shorter text of names, in turn by
induction as long as it doesn't fit ``base`` names. From sorted seeds a scan in ascending order pushes each suffix's left
neighbour, if L, into the bucket of its first character; a scan in descending order does so for S. Within a bucket suffixes leave
as they came, so a bucket queue is the priority queue. Each pushed tuple carries the common prefix with the tuple pushed before it
into the same bucket: one more than the least common prefix between the two suffixes that pushed them. Prefixes are counted up to
``CAP``.

All work is on arrays, a bucket's run at a time; tuples beyond ``memory`` wait in an unnamed temporary file of the task, which is
gone when the task ends or its executor is lost.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 100
MEMORY = 1 << 23
BASE = 1 << 22


class Buckets:
    """Queues of (position, common prefix) tuples by character; tuples leave a bucket in the order in which they came."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.parts: dict[int, list] = {}
        self.heap: list[int] = []
        self.held, self.memory, self.file = 0, memory, None

    def push(self, char: int, positions: np.ndarray, lcps: np.ndarray) -> None:
        if char not in self.parts:
            self.parts[char] = []
            heapq.heappush(self.heap, char)
        self.parts[char].append((positions, lcps))
        self.held += len(positions)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, part in enumerate(parts):
                if not isinstance(part[0], int):
                    at = self.file.tell()
                    self.file.write(part[0].astype(np.int64).tobytes() + part[1].astype(np.uint8).tobytes())
                    parts[k] = (at, len(part[0]))
        self.held = 0

    def _loaded(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(part[0], int):
            self.held -= len(part[0])
            return part
        self.file.seek(part[0])
        data = self.file.read(9 * part[1])
        return np.frombuffer(data, np.int64, part[1]), np.frombuffer(data, np.uint8, part[1], 8 * part[1])

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a bucket, which is empty then."""
        parts = [self._loaded(p) for p in self.parts.pop(char, [])]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def next(self) -> int | None:
        while self.heap and self.heap[0] not in self.parts:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None


class _Minima:
    """Least values of ranges of an array of small numbers, by a table of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, k = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-k], last[k:]))

    def over(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of [start, end); ranges aren't empty."""
        out = np.empty(len(starts), np.int16)
        level = np.frexp((ends - starts).astype(np.float64))[1] - 1
        for k in range(len(self.rows)):
            if len(of := np.flatnonzero(level == k)):
                row = self.rows[k]
                out[of] = np.minimum(row[starts[of]], row[ends[of] - (1 << k)])
        return out


class _Pushes:
    """Pushes of a scan: left neighbours of the suffixes scanned, into the buckets of their characters."""

    def __init__(self, text: np.ndarray, sigma: int, lcp: bool, memory: int, sign: int) -> None:
        self.text, self.queue, self.sign = text, Buckets(memory), sign
        self.since = np.full(sigma, -1, np.int16) if lcp else None  # least prefix since a bucket's last tuple; -1 while it has none

    def scan(self, positions: np.ndarray, lcps: np.ndarray, keep) -> None:
        left = positions - 1
        chars = self.text[left]  # of -1: the end mark, which is no neighbour of any
        at = np.flatnonzero(keep(chars) & (left >= 0))
        if not len(at):
            if self.since is not None and len(lcps):
                np.minimum(self.since, lcps.min(), out=self.since)
            return
        order = np.argsort(chars[at], kind="stable")
        at = at[order]
        sorted_chars, left = chars[at], left[at]
        first = np.flatnonzero(np.r_[True, sorted_chars[1:] != sorted_chars[:-1]])
        ends = np.r_[first[1:], len(at)]
        groups = sorted_chars[first].astype(np.int64)
        if self.since is None:
            new = np.zeros(len(at), np.uint8)
        else:
            minima = _Minima(lcps)
            starts = np.r_[0, at[:-1] + 1]
            starts[first] = 0
            new = minima.over(starts, at + 1)
            new[first] = np.minimum(new[first], self.since[groups])
            new = np.minimum(new + 1, CAP).astype(np.uint8)
            np.minimum(self.since, lcps.min(), out=self.since)
            last = at[ends - 1] + 1
            open_ = last < len(lcps)
            self.since[groups] = CAP
            self.since[groups[open_]] = minima.over(last[open_], np.full(open_.sum(), len(lcps)))
        for char, a, b in zip(groups.tolist(), first.tolist(), ends.tolist(), strict=True):
            self.queue.push(self.sign * char, left[a:b], new[a:b])


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the last one, the end mark, is."""
    turns = np.flatnonzero(text[1:] != text[:-1])
    out = np.ones(len(text), bool)
    out[: turns[-1] + 1] = np.repeat(text[turns] < text[turns + 1], np.diff(np.r_[-1, turns]))
    return out


def _run(text: np.ndarray, at: int) -> int:
    """How often the character at ``at`` repeats, up to CAP."""
    return int(np.argmin(np.r_[text[at : at + CAP] == text[at], False]))


def induced(text: np.ndarray, sigma: int, seeds: np.ndarray, lcps: np.ndarray | None, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefixes with the one before) in order within a block, a block a first character, descending."""
    counts = lcps is not None
    lcps = np.zeros(len(seeds), np.uint8) if lcps is None else lcps
    of = text[seeds]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
    groups = {int(of[a]): (a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
    chars, up, done = sorted(groups), _Pushes(text, sigma, counts, memory, 1), Buckets(memory)
    turn, k = up.queue.next(), 0
    while turn is not None or k < len(chars):
        char = min(x for x in (turn, chars[k] if k < len(chars) else None) if x is not None)
        last = None
        while char in up.queue.parts:
            positions, own = up.queue.take(char)
            done.push(char, positions, own)
            up.scan(positions, own, lambda c, char=char: c >= char)
            last = int(positions[-1])
        if char in groups:
            a, b = groups[char]
            own = lcps[a:b].copy()
            own[0] = min(_run(text, last), _run(text, int(seeds[a]))) if counts and last is not None else 0
            up.scan(seeds[a:b], own, lambda c, char=char: c > char)
            k += 1
        turn = up.queue.next()
    down = _Pushes(text, sigma, counts, memory, -1)
    left = sorted(done.parts)
    turn = down.queue.next()
    while left or turn is not None:
        char = max(x for x in (left[-1] if left else None, None if turn is None else -turn) if x is not None)
        small, parts = None, []
        while -char in down.queue.parts:
            parts.append(down.queue.take(-char))
            down.scan(*parts[-1], lambda c, char=char: c <= char)
            small = int(parts[-1][0][-1])
        s_pos, s_lcp = (np.concatenate([p[0] for p in parts])[::-1], np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        s_lcp = np.r_[np.uint8(0), s_lcp[:0:-1]] if len(s_lcp) else s_lcp
        l_pos, l_lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if left and left[-1] == char:
            left.pop()
            l_pos, l_lcp = done.take(char)
            between = np.uint8(min(_run(text, int(l_pos[-1])), _run(text, small))) if counts and small is not None else np.uint8(0)
            down.scan(l_pos[::-1], np.r_[between, l_lcp[:0:-1]], lambda c, char=char: c < char)
            if len(s_lcp):
                s_lcp[0] = between
        yield np.concatenate([l_pos, s_pos]), np.concatenate([l_lcp, s_lcp])
        turn = down.queue.next()


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes, up to CAP, of pairs of different suffixes; eight characters at a time."""
    padded = np.concatenate([text, np.zeros(CAP + 8, np.uint8)])
    eight = np.ndarray((len(text) + CAP,), "<u8", padded, 0, (1,))
    out = np.full(len(a), CAP, np.uint8)
    todo = np.arange(len(a))
    for at in range(0, CAP, 8):
        differ = eight[a[todo] + at] ^ eight[b[todo] + at]
        ended = differ != 0
        lowest = differ[ended] & (~differ[ended] + np.uint64(1))
        out[todo[ended]] = np.minimum(at + (np.frexp(lowest.astype(np.float64))[1] - 1) // 8, CAP)
        todo = todo[~ended]
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a short text of names, by their first CAP names at least: ranks of doubling lengths."""
    rank, k = names.astype(np.int64), 1
    while k < CAP:
        key = rank * (len(rank) + 1)
        key[: len(key) - k] += rank[k:] + 1
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == len(rank):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def _sorted_seeds(text: np.ndarray, sigma: int, memory: int, base: int) -> np.ndarray:
    """The seeds in order of their suffixes."""
    s = s_types(text)
    marked = s & np.r_[False, ~s[:-1]]
    seeds = np.flatnonzero(marked)
    if len(seeds) < 2:
        return seeds
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    blocks = [p[marked[p]] for p, _ in induced(text, sigma, rough, None, memory)]
    order = np.concatenate([np.array([len(text) - 1]), *[b for b in blocks[::-1] if len(b) and b[0] != len(text) - 1]])
    rank_of = np.searchsorted(seeds, order)
    sizes = np.diff(np.r_[seeds, len(text) - 1]) + 1  # up to and with the next seed
    same = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(sizes[rank_of[:-1]] == sizes[rank_of[1:]])
    for at in range(0, len(alike), 1 << 18):
        part = alike[at : at + (1 << 18)]
        n = sizes[rank_of[part]]
        starts = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(starts, n)
        equal = text[np.repeat(a[part], n) + step] == text[np.repeat(b[part], n) + step]
        same[part + 1] = np.logical_and.reduceat(equal, starts)
    name = np.cumsum(~same) - 1
    names = np.empty(len(seeds), np.int64)
    names[rank_of] = name
    if name[-1] + 1 == len(seeds):
        return order
    if len(names) <= base:
        return seeds[_doubled(names)]
    inner = np.r_[names + 1, 0]  # the sequence of names, with an end mark of its own
    ends = _sorted_seeds(inner, int(name[-1]) + 3, memory, base)
    blocks = [p for p, _ in induced(inner, int(name[-1]) + 3, ends, None, memory)]
    return seeds[np.concatenate([p[p < len(names)] for p in blocks[::-1]])]


def suffix_blocks(text: np.ndarray, memory: int = MEMORY, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefixes) of all suffixes but the end mark's, in order within a block; blocks differ in the first character.

    ``text`` is bytes that end with 0, which stands nowhere else. ``memory``: tuples held by a queue; ``base``: names sorted without induction.
    """
    seeds = _sorted_seeds(text, 256, memory, base)
    lcps = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        lcps[1:] = common_prefixes(text, seeds[:-1], seeds[1:])
    yield from induced(text, 256, seeds, lcps, memory)
