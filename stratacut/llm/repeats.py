"""Operator 12: remove every byte that a string of ``SIZE`` (100) bytes covers which also starts earlier in the corpus.

Equal windows of 100 bytes have to meet, so windows are dealt by content. A window's anchor is the leftmost of its 61 stretches of
40 bytes with the least hash; neighbouring windows share their anchor, so a text of n bytes has about n / 30. The rest follows
the anchors:

1. *Routes.* Anchors' hashes are gathered by bucket; those found twice send the place of their windows back to their document.
2. *Passages.* A document cuts the passage around each such anchor (all windows of that anchor) out of its text. Of equal passages
   in a batch of documents the first goes on and the windows of the others are removed at once, so a passage in a third of all
   documents is a row a batch.
3. *Shards.* Passages are dealt by anchor. Of equal ones the first stays; where an anchor has different passages, these are a
   shard's text, whose suffixes are put in order with their common prefixes by induced sorting in queues that spill to disk
   (``suffix_order``). A run of windows whose common prefixes reach 100 is a class; all but its first window are removed.
4. *Texts.* The removed windows of a document are merged and cut out.

An anchor with very many different surroundings (a line that many documents share) would be a large group. ``hot`` passages or
more, or ``hot_here`` in one batch, make it hot: its windows are dealt one by one by a 128-bit hash, the first of each batch only.
Both ways are exact up to collisions of 128-bit hashes of text.

The order of windows is (doc_id, place). Defined results: a null text is an empty text; texts under 100 bytes lose nothing;
equal rows of one doc_id are one document and lose the same; different texts of one doc_id are ordered by their crc32, those with a
null doc_id come after all others; an empty table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle, settled, slices, stored
from stratacut.llm.hashing import BASE, BYTE, U, mixed, word_hashes
from stratacut.llm.suffix_order import CAP, suffix_blocks

SIZE = CAP
STRETCH = 40
WINDOW = SIZE - STRETCH + 1
PIECE, FLUSH = 1 << 20, 1 << 24
INVERSE = U(pow(int(BASE), -1, 1 << 64))
KEY = U((1 << 48) - 1)
LAST = np.iinfo(np.int64).max
ROUTE = [("key", "<u8"), ("id", "<i8"), ("var", "<i8"), ("at", "<i8")]
PLACE_BITS = 14


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor's distance from the first window, anchor's hash) of every run of windows with one anchor.

    Texts over a megabyte are taken a megabyte of windows at a time, which at worst cuts a run in two.
    """
    found, pieces, size = [], [], 0

    def flush() -> None:
        if pieces:
            found.append(_anchors([p for _, _, p in pieces], np.array([t for t, _, _ in pieces]), np.array([o for _, o, _ in pieces])))
            pieces.clear()

    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - SIZE + 1, 0), PIECE):
            pieces.append((k, at, text[at : at + PIECE + SIZE - 1]))
            size += len(pieces[-1][2])
            if size > PIECE:
                flush()
                size = 0
    flush()
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _anchors(pieces: list[bytes], text_of: np.ndarray, offset: np.ndarray) -> tuple:
    t = np.frombuffer(b"".join(pieces), np.uint8)
    n, ends = len(t), np.cumsum([len(p) for p in pieces])
    if not _powers:
        most = 2 * PIECE + 2 * SIZE
        _powers[0] = np.cumprod(np.full(most, BASE, np.uint64)), np.cumprod(np.full(most, INVERSE, np.uint64))
    up, down = (p[:n] for p in _powers[0])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[t] * up, out=sums[1:])
    m = n - STRETCH + 1
    h = mixed((sums[STRETCH:] - sums[:-STRETCH]) * down[:m])
    # least hash of each window, leftmost on ties: prefix and suffix minima of blocks, places of a block in the low bits
    blocks = np.full(-(-m // WINDOW) * WINDOW, ~U(0))
    blocks[:m] = h
    blocks = ((blocks & ~U(127)).reshape(-1, WINDOW) | np.arange(WINDOW, dtype=np.uint64))
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - SIZE + 1)
    a, b = after[p], before[p + WINDOW - 1]
    anchor = np.where(a >> U(7) <= b >> U(7), p // WINDOW * WINDOW + (a & U(127)).astype(np.int64), (p + WINDOW - 1) // WINDOW * WINDOW + (b & U(127)).astype(np.int64))
    piece = np.repeat(np.arange(len(pieces)), np.diff(np.r_[0, ends]))[p]
    whole = p + SIZE <= ends[piece]
    p, anchor, piece = p[whole], anchor[whole], piece[whole]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    runs, of = np.diff(np.r_[first, len(p)]), piece[first]
    start = p[first] - np.r_[0, ends[:-1]][of] + offset[of]
    return text_of[of], start, runs, anchor[first] - p[first], h[anchor[first]]


def _documents(batches: Iterator[pa.RecordBatch], size: int = FLUSH) -> Iterator[tuple]:
    """Columns of whole rows of at least ``size`` bytes of text together; columns are id, var, text and what else there is."""
    rows, held = [], 0
    for batch in slices(batches, 500):
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            row = (*row[:2], row[2] or b"", *row[3:])
            rows.append(row)
            held += len(row[2])
            if held >= size:
                yield tuple(zip(*rows, strict=True))
                rows, held = [], 0
    if rows:
        yield tuple(zip(*rows, strict=True))


def _packed(entries: np.ndarray) -> bytes:
    """A few bytes an entry: columns one after another, places and ids as differences."""
    whole = b"".join(np.ascontiguousarray(x).tobytes() for x in (entries["key"], np.diff(entries["id"], prepend=0), entries["var"].astype("<u4"), np.diff(entries["at"], prepend=0)))
    return len(entries).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(whole)


def _unpacked(data: bytes) -> np.ndarray:
    n, whole = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:])
    out = np.empty(n, ROUTE)
    out["key"] = np.frombuffer(whole, "<u8", n)
    out["id"] = np.cumsum(np.frombuffer(whole, "<i8", n, 8 * n))
    out["var"] = np.frombuffer(whole, "<u4", n, 16 * n)
    out["at"] = np.cumsum(np.frombuffer(whole, "<i8", n, 20 * n))
    return out


def routes(texts: DataFrame, n_buckets: int, hot: int, hot_here: int) -> DataFrame:
    """(id, var, at): for a document and a bucket the places of its windows whose anchor occurs twice or more.

    A place is first window, windows, anchor and whether the anchor is hot, in one number.
    """

    @settled
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, variants, bodies in _documents(batches):
            of, start, runs, distance, h = anchors(bodies)
            entries = np.empty(len(of), ROUTE)
            entries["key"], entries["id"], entries["var"] = h & KEY, np.array(ids, np.int64)[of], np.array(variants, np.int64)[of]
            entries["at"] = start << PLACE_BITS | runs << 7 | distance << 1
            _, group, counts = np.unique(entries["key"], return_inverse=True, return_counts=True)
            busy = counts[group] >= hot_here
            marks = np.unique(entries["key"][busy])
            note = np.zeros(len(marks), ROUTE)
            note["key"], note["at"] = marks, -1
            home = np.concatenate([entries[~busy], note])
            bucket = home["key"] % U(n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, home = bucket[order], home[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            parts = [(int(bucket[a]), 0, _packed(home[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            if busy.any():  # known to be hot: to any bucket
                parts.append((int(h[0] % U(n_buckets)), 1, _packed(entries[busy])))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["bucket", "known", "entries"])

    def found(table: pa.Table) -> pa.Table:
        kinds = table.column("known").to_pylist()
        parts = [_unpacked(x) for x in table.column("entries").to_pylist()]
        out = [p for p, k in zip(parts, kinds, strict=True) if k]
        for p in out:
            p["at"] |= 1
        home = np.concatenate([p for p, k in zip(parts, kinds, strict=True) if not k] or [np.empty(0, ROUTE)])
        _, group, counts = np.unique(home["key"], return_inverse=True, return_counts=True)
        marked = np.zeros(len(counts), bool)
        marked[group[home["at"] < 0]] = True
        twice = (counts[group] >= 2) & (home["at"] >= 0)
        home["at"][(marked | (counts >= hot))[group] & twice] |= 1
        every = np.concatenate([*out, home[twice]])
        every = every[np.lexsort((every["var"], every["id"]))]
        new = np.flatnonzero(np.r_[True, (every["id"][1:] != every["id"][:-1]) | (every["var"][1:] != every["var"][:-1])]) if len(every) else np.zeros(0, int)
        places = np.ascontiguousarray(every["at"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(every)], pa.int32()), pa.array(places, pa.int64()))
        settle()
        return pa.table([pa.array(every["id"][new], pa.int64()), pa.array(every["var"][new], pa.int64()), lists], ["id", "var", "at"])

    shards = texts.mapInArrow(gather, "bucket long, known int, entries binary")
    return shards.groupBy("bucket").applyInArrow(found, "id long, var long, at array<long>")


PART = [("kind", "<u1"), ("key", "<u8"), ("same", "<u8"), ("id", "<i8"), ("var", "<u4"), ("start", "<i8"), ("windows", "<i4")]
PASSAGE, HOT, GONE = 0, 1, 2


def _runs(ids: np.ndarray, variants: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed windows, merged where they follow one another: id, var, first byte, end."""
    order = np.lexsort((starts, variants, ids))
    ids, variants, starts, ends = ids[order], variants[order], starts[order], (starts + widths)[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (variants[1:] != variants[:-1]) | (starts[1:] > ends[:-1])]) if len(ids) else np.zeros(0, int)
    last = np.r_[new[1:], len(ids)][: len(new)] - 1
    return ids[new], variants[new], starts[new], ends[last] + SIZE - 1


def _firsts(key: np.ndarray, same: np.ndarray, ids: np.ndarray, variants: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, same, place), and which of that order is the first of its (key, same)."""
    order = np.lexsort((starts, variants, ids, same, key))
    k, s = key[order], same[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])] if len(order) else np.zeros(0, bool)


def _as_places(ids, variants, starts) -> np.ndarray:
    return np.stack([ids, variants, starts], axis=1)


def _not_first(order: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of a sorted order, those whose place isn't the first one's: equal rows of a document don't remove one another."""
    if not len(order):
        return order
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[(places[order] != places[order[head]]).any(axis=1)]


def _part(kind: int, key, same, ids, variants, starts, windows) -> np.ndarray:
    out = np.empty(len(ids), PART)
    out["kind"] = kind
    for name, x in zip(("key", "same", "id", "var", "start", "windows"), (key, same, ids, variants, starts, windows), strict=True):
        out[name] = x
    return out


def _packed_parts(parts: np.ndarray, passages: list[bytes]) -> bytes:
    """Columns one after another, then the passages; these are as long as their windows say."""
    columns = b"".join(np.ascontiguousarray(parts[name]).tobytes() for name, _ in PART)
    return len(parts).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(columns + b"".join(passages))


def _unpacked_parts(data: bytes) -> tuple[np.ndarray, bytes]:
    n, whole, at = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:]), 0
    out = np.empty(n, PART)
    for name, kind in PART:
        out[name] = np.frombuffer(whole, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out, whole[at:]


def parts_of(linked: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, parts) of rows (id, var, text, at): passages with their text, hot windows, and windows that are removed already."""

    @settled
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, variants, bodies, places in _documents(batches):
            at = [np.unique(np.concatenate([np.asarray(x, np.int64) for x in p])) for p in places]
            of = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate(at)
            start, runs, distance, is_hot = at >> PLACE_BITS, at >> 7 & 127, at >> 1 & 63, at & 1
            begin = np.cumsum([0, *map(len, bodies)])[:-1][of] + start
            end = begin + runs + SIZE - 1
            joined = b"".join(bodies)
            whole = np.frombuffer(joined, np.uint8)
            id_, var = np.array(ids, np.int64)[of], np.array(variants, np.int64)[of]
            key, same = np.empty(len(of), np.uint64), np.empty(len(of), np.uint64)
            for k in range(0, len(of), 20_000):
                s = slice(k, k + 20_000)
                key[s] = word_hashes(whole, begin[s] + distance[s], begin[s] + distance[s] + STRETCH)
                same[s] = word_hashes(whole, begin[s], end[s])
            same = mixed(same + (runs << 7 | distance).astype(np.uint64))
            order, first = _firsts(key, same, id_, var, start)
            removed = _not_first(order, first, _as_places(id_, var, start))
            gone = [(id_[removed], var[removed], start[removed], runs[removed])]
            kept = order[first]
            cold, warm = kept[is_hot[kept] == 0], kept[is_hot[kept] == 1]
            parts = [_part(PASSAGE, key[cold], same[cold], id_[cold], var[cold], start[cold], runs[cold])]
            if len(warm):
                each = np.repeat(warm, runs[warm])
                step = np.arange(len(each)) - np.repeat(np.cumsum(runs[warm]) - runs[warm], runs[warm])
                w_id, w_var, w_start = id_[each], var[each], start[each] + step
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[b : b + SIZE]) for b in (begin[each] + step).tolist()]), "<u8").reshape(-1, 2)
                w_order, w_first = _firsts(digests[:, 0], digests[:, 1], w_id, w_var, w_start)
                r = _not_first(w_order, w_first, _as_places(w_id, w_var, w_start))
                gone.append((w_id[r], w_var[r], w_start[r], np.ones(len(r), np.int64)))
                w = w_order[w_first]
                parts.append(_part(HOT, digests[w, 0], digests[w, 1], w_id[w], w_var[w], w_start[w], 1))
            i, v, s, e = _runs(*(np.concatenate(x) for x in zip(*gone, strict=True)))
            parts.append(_part(GONE, mixed(i.astype(np.uint64) + s.astype(np.uint64)), 0, i, v, s, e - s))
            parts = np.concatenate(parts)
            bucket = (parts["key"] % U(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, int)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = order[a:b]
                c = cold[rows[rows < len(cold)]]
                out.append((int(bucket[rows[0]]), _packed_parts(parts[rows], [joined[x:y] for x, y in zip(begin[c].tolist(), end[c].tolist(), strict=True)])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "parts"])

    return linked.mapInArrow(cut, "bucket long, parts binary")


def repeated_windows(passages: list[bytes], windows: np.ndarray, places: np.ndarray, memory: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, window): windows of a shard's passages that also start at an earlier place; ``places``: id, var and first window."""
    sizes = np.array([len(p) for p in passages])
    text = np.ones(sizes.sum() + len(sizes) + 1, np.uint8)  # 1 ends a passage, 0 the text
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[:-1][np.arange(len(owner)) - begin[owner] < sizes[owner]] = np.frombuffer(b"".join(passages), np.uint8) + 2  # 255 and 254 aren't UTF-8
    text[-1] = 0
    found = []
    for positions, lcps in suffix_blocks(text, **({} if memory is None else {"memory": memory})):
        group = np.cumsum(lcps < SIZE)
        inside = positions < len(owner)
        positions, group = positions[inside], group[inside]
        of = owner[positions]
        window = positions - begin[of]
        valid = window < windows[of]
        of, window, group = of[valid], window[valid], group[valid]
        many = np.bincount(group)[group] > 1
        of, window, group = of[many], window[many], group[many]
        if len(of):
            place = places[of].copy()
            place[:, 2] += window
            order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], group))
            g = group[order]
            late = _not_first(order, np.r_[True, g[1:] != g[:-1]], place)
            found.append(np.stack([of[late], window[late]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, int), np.zeros(0, int))


def removals(parts: DataFrame, shard_bytes: int = 1 << 22) -> DataFrame:
    """(id, var, start, end): bytes to remove, a row a run of windows found together. A bucket's shards hold about ``shard_bytes`` of text."""

    def resolve(table: pa.Table) -> pa.Table:
        found = [_unpacked_parts(x) for x in table.column("parts").to_pylist()]
        whole, bodies = np.concatenate([p for p, _ in found]), b"".join(b for _, b in found)
        del found
        done = whole[whole["kind"] == GONE]
        gone = []
        for kind in (HOT, PASSAGE):
            p = whole[whole["kind"] == kind]
            i, v, s, n = (p[c].astype(np.int64) for c in ("id", "var", "start", "windows"))
            order, first = _firsts(p["key"], p["same"], i, v, s)
            late = _not_first(order, first, _as_places(i, v, s))
            gone.append((i[late], v[late], s[late], n[late]))
        kept = order[first]  # passages, by key
        key = p["key"][kept]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(kept) else kept
        several = np.bincount(group)[group] > 1 if len(kept) else np.zeros(0, bool)
        kept, group = kept[several], group[several]
        sizes = n + SIZE - 1
        begin = np.cumsum(sizes) - sizes
        place = _as_places(i, v, s)
        at = 0
        while at < len(kept):  # keys one after another
            end = int(np.searchsorted(np.cumsum(sizes[kept[at:]]), shard_bytes)) + at
            end = int(np.searchsorted(group, group[min(end, len(kept) - 1)], side="right"))
            rows = kept[at:end]
            texts = [bodies[a:b] for a, b in zip(begin[rows].tolist(), (begin[rows] + sizes[rows]).tolist(), strict=True)]
            of, window = repeated_windows(texts, n[rows], place[rows])
            gone.append((i[rows][of], v[rows][of], s[rows][of] + window, np.ones(len(of), np.int64)))
            at = end
        i, v, s, e = _runs(*(np.concatenate(x) for x in zip(*gone, strict=True)))
        columns = [np.r_[done["id"], i], np.r_[done["var"].astype(np.int64), v], np.r_[done["start"], s], np.r_[done["start"] + done["windows"], e]]
        settle()
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["id", "var", "start", "end"])

    return parts.groupBy("bucket").applyInArrow(resolve, "id long, var long, start long, end long")


def drop_repeats(docs: DataFrame, n_buckets: int | None = None, hot: int = 1000, hot_here: int = 64) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay, which may cut a character), n_bytes, n_removed and spans (start, end).

    If ``docs`` has columns of those names, underscores are appended. ``n_buckets``: of the anchors' exchange, four a shuffle partition.
    """
    n_buckets = n_buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_, var = (fresh(c, docs.columns) for c in ("_id", "_var"))
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(var, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    texts = keyed.select("text", F.col(id_).alias("id"), F.col(var).alias("var"))  # in the order of ``keyed``: one exchange serves both joins
    found = stored(routes(texts.select("id", "var", "text"), n_buckets, hot, hot_here)).groupBy("id", "var").agg(F.collect_list("at").alias("at"))
    linked = texts.join(found.hint("shuffle_hash"), ["id", "var"]).select("id", "var", "text", "at")
    gone = removals(parts_of(linked, n_buckets)).groupBy("id", "var").agg(F.collect_list(F.struct("start", "end")).alias("of"))

    kept, n_bytes, n_removed, spans = (fresh(c, docs.columns) for c in ("kept", "n_bytes", "n_removed", "spans"))

    @F.arrow_udf("struct<kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>>")
    def cut(bodies: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(bodies), 500):
            for text, own in zip(bodies.slice(at, 500).cast(pa.binary()).to_pylist(), runs.slice(at, 500).to_pylist(), strict=True):
                body = text or b""
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in own or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                stays = b"".join(body[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(body)], strict=True))
                out.append({"kept": stays, "n_bytes": len(body), "n_removed": len(body) - len(stays), "spans": [{"start": a, "end": b} for a, b in merged]})
        settle()
        return pa.array(out, pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    gone = gone.select(F.col("id").alias(f"{id_}g"), F.col("var").alias(f"{var}g"), F.col("of").alias(fresh("_of", docs.columns)))
    joined = keyed.join(gone.hint("shuffle_hash"), (F.col(id_) == F.col(f"{id_}g")) & (F.col(var) == F.col(f"{var}g")), "left")
    made = fresh("_made", docs.columns)
    # ids come from the exchanged key, so that this exchange of texts is the one that the passages were cut from
    whole_ids = docs.schema["doc_id"].dataType.typeName() in ("long", "integer")
    doc_id = F.when(F.col(id_) < LAST, F.col(id_)).cast(docs.schema["doc_id"].dataType) if whole_ids else F.col("doc_id")
    whole = joined.withColumn(made, cut(F.col("text"), F.col(fresh("_of", docs.columns))))
    return whole.select(*[doc_id.alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{made}.{field}").alias(name) for field, name in (("kept", kept), ("n_bytes", n_bytes), ("n_removed", n_removed), ("spans", spans))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_array_dedup": query}
ORACLES: dict[str, str] = {}
