"""Weighted acyclic automata over words: counts of phrases of up to three words, in two forms.

``Shard`` is what a task makes of its sorted n-grams and sends on: the words in use, and arrays of arcs in which states with equal
arcs are one state. ``Phrases`` is a walkable automaton for the far fewer phrases that stay after counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

WORD = 21  # bits of a word's number in a shard
NONE = 0


class Shard:
    """Counts of a shard's n-grams below a range of prefixes.

    ``ones``: words and their counts; ``paths``: sorted numbers of (first, second, third word or NONE) and their counts. From the root
    a first word leads to its second words, a second word to a state, whose arcs are third words with counts (NONE: the text ended).
    """

    def __init__(self, words: list[bytes], ones: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, ...]) -> None:
        self.words, self.ones, self.paths = words, ones, paths

    def packed(self) -> bytes:
        first, second, third, count = self.paths
        new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, int)
        sizes = np.diff(np.r_[new, len(first)])
        arcs = np.stack([third, count]).astype("<u4")
        state = np.empty(len(new), np.int64)
        single = np.flatnonzero(sizes == 1)
        alone, state[single] = np.unique(arcs[0, new[single]].astype(np.int64) << 32 | arcs[1, new[single]], return_inverse=True)
        register: dict[bytes, int] = {}  # closed states of several arcs by their arcs
        kept = []
        for k in np.flatnonzero(sizes > 1).tolist():
            own = arcs[:, new[k] : new[k] + sizes[k]].tobytes()
            at = register.setdefault(own, len(register))
            if at == len(kept):
                kept.append((int(new[k]), int(sizes[k])))
            state[k] = len(alone) + at
        take = np.concatenate([np.arange(a, a + n) for a, n in kept]) if kept else np.zeros(0, int)
        third_arcs = np.r_[alone >> 32, arcs[0, take]].astype("<u4")
        counts = np.r_[alone & 0xFFFFFFFF, arcs[1, take]].astype("<u4")
        widths = np.array([n for _, n in kept], "<u4")
        columns = [self.ones[0], self.ones[1], np.diff(first[new], prepend=0), second[new], state, third_arcs, counts, widths]
        head = np.array([len(self.ones[0]), len(new), len(alone), len(kept), len(take)], "<u8").tobytes()
        body = head + b"".join(np.ascontiguousarray(c, "<u4").tobytes() for c in columns) + b"\n".join(self.words)
        return zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def unpacked(data: bytes) -> Shard:
        body = zstandard.ZstdDecompressor().decompress(data)
        n_ones, n_pairs, n_alone, n_kept, n_take = (int(x) for x in np.frombuffer(body, "<u8", 5))
        at, columns = 40, []
        for n in (n_ones, n_ones, n_pairs, n_pairs, n_pairs, n_alone + n_take, n_alone + n_take, n_kept):
            columns.append(np.frombuffer(body, "<u4", n, at).astype(np.int64))
            at += 4 * n
        one, one_count, first, second, state, third, count, widths = columns
        sizes = np.r_[np.ones(n_alone, np.int64), widths]
        begin = np.cumsum(sizes) - sizes
        n = sizes[state]
        arc = np.repeat(begin[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        paths = np.repeat(np.cumsum(first), n), np.repeat(second, n), third[arc], count[arc]
        return Shard(body[at:].split(b"\n") if at < len(body) else [], (one, one_count), paths)


def summed(shards: list[bytes]) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The union of shards, weights added: words, their counts, pairs of words and triples of words with theirs (numbers from 0)."""
    number: dict[bytes, int] = {}
    number_of = number.setdefault
    ones, paths = [], []
    for data in shards:
        shard = Shard.unpacked(data)
        of = np.array([-1, *(number_of(w, len(number)) for w in shard.words)], np.int64)
        ones.append((of[shard.ones[0]], shard.ones[1]))
        first, second, third, count = shard.paths
        paths.append((of[first] << 32 | of[second], of[third], count))
    word, count = (np.concatenate(x) for x in zip(*ones, strict=True))
    counts = np.bincount(word, count, len(number)).astype(np.int64)
    present = np.flatnonzero(counts)
    key, third, count = (np.concatenate(x) for x in zip(*paths, strict=True))
    pair, of = np.unique(key, return_inverse=True)
    pair_count = np.bincount(of, count, len(pair)).astype(np.int64)
    whole = third >= 0
    triple, of_triple = np.unique(of[whole] << 32 | third[whole], return_inverse=True)
    triple_count = np.bincount(of_triple, count[whole], len(triple)).astype(np.int64)
    under = pair[triple >> 32]
    return list(number), (present, counts[present]), (pair >> 32, pair & 0xFFFFFFFF, pair_count), (under >> 32, under & 0xFFFFFFFF, triple & 0xFFFFFFFF, triple_count)


class Phrases:
    """A walkable automaton from words to weights; where a phrase is added again, ``join`` of both weights counts."""

    def __init__(self, join=max) -> None:
        self.root: dict = {}
        self.join = join

    def add(self, words: tuple[bytes, ...], weight: int) -> None:
        state = self.root
        for word in words[:-1]:
            state = state.setdefault(word, [None, {}])[1]
        arc = state.setdefault(words[-1], [None, {}])
        arc[0] = weight if arc[0] is None else self.join(arc[0], weight)

    def weight(self, words: tuple[bytes, ...]) -> int | None:
        state = self.root
        for word in words[:-1]:
            if word not in state:
                return None
            state = state[word][1]
        return state[words[-1]][0] if words[-1] in state else None

    def __iter__(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        def walk(state: dict, so_far: tuple[bytes, ...]) -> Iterator:
            for word in sorted(state):
                weight, below = state[word]
                if weight is not None:
                    yield (*so_far, word), weight
                yield from walk(below, (*so_far, word))

        yield from walk(self.root, ())

    def composed(self, other: Phrases) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
        """Phrases that both accept, with both weights: both automata are walked together, along arcs that both have."""

        def walk(a: dict, b: dict, so_far: tuple[bytes, ...]) -> Iterator:
            for word in a if len(a) <= len(b) else b:
                if word in a and word in b:
                    (x, below), (y, beside) = a[word], b[word]
                    if x is not None and y is not None:
                        yield (*so_far, word), x, y
                    if below and beside:
                        yield from walk(below, beside, (*so_far, word))

        yield from walk(self.root, other.root, ())
