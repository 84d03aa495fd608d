"""Removal of byte strings that repeat across documents, by a distributed sort of suffixes.

A byte is removed if a string of ``length`` bytes over it also starts in a
document with a smaller id. Only suffixes that can take part are sorted: every
string of ``length`` bytes holds a *mark*, the start of its ``K``-byte piece of
smallest hash, at the same place wherever the string occurs.

1. Texts that are whole copies of an earlier one are set apart.
2. Hashes of marks are exchanged as packed runs; marks whose piece is in one
   text only are done with.
3. The suffixes at the other marks are sorted in each task, equal contexts are
   settled on the spot, and the rest are exchanged as front-coded sorted runs
   (common prefix length and tail) by their first ``K`` bytes.
4. Runs are merged by a loser tree that carries common prefix lengths: a
   comparison starts where the known prefix ends. The merged prefix lengths give
   the classes of equal strings around each mark, exactly, without pairs.
5. Intervals are gathered by text and joined to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import cut, partitions, slices, small, trim
from grovekit.llm.rolling import _BASE, _INVERSE, BYTES, mix, powers

LENGTH = 50
K = 16
LAST = (1 << 63) - 1  # where rows without an id stand
_FLUSH_MARKS, _FLUSH_SUFFIXES = 500_000, 100_000
_H32 = np.uint64((1 << 32) - 1)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns one after the other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    """Columns of equal length and the given kinds."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over every ``width`` neighbours, by doubling."""
    n, now, have = len(x) - width + 1, x, 1
    while 2 * have <= width:
        now = f(now[: len(now) - have], now[have:])
        have *= 2
    return f(now[:n], now[width - have : width - have + n]) if have < width else now[:n]


def marks(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and piece hash of each mark."""
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
    h = mix((sums[K:] - sums[:-K]) * powers(_INVERSE, len(data))[: len(data) - K + 1])
    h |= np.uint64(1)  # 0 stands for strings over the end of a text
    width = length - K + 1
    least = _slide(h, width, np.minimum)
    ends = np.cumsum(lens)
    for z in ends[:-1].tolist():
        least[max(0, z - length + 1) : z] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum) == h)
    who = np.searchsorted(ends, at, "right")
    return who, at - (ends - lens)[who], h[at]


def _mark_runs(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed marks by bucket of their hash, and the names of texts (``sha`` set): rows of ``text, rank, sha``."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    names = ["bucket", "base", "rank", "sha", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        held: list[tuple] = []
        total = count = 0

        def flush() -> pa.RecordBatch:
            who, place, h = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.argsort(h)
            who, place, h = who[by], place[by], h[by]
            at = np.searchsorted((h >> bits).astype(np.int64), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            low = ((h >> (bits - np.uint64(32))) & _H32).astype(np.uint32)
            who, place = who.astype(np.uint32), place.astype(np.uint32)
            packs = [_packed(low[at[i] : at[i + 1]], who[at[i] : at[i + 1]], place[at[i] : at[i + 1]]) for i in full]
            n = len(full)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([base] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(packs, pa.binary())], names=names)

        for b in slices(batches, 1 << 19):
            texts = b.column("text").to_pylist()
            who, place, h = marks(texts, length)
            n = len(texts)
            ids = base + count + np.arange(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids % buckets), pa.array(ids), b.column("rank"), b.column("sha"), pa.nulls(n, pa.binary())], names=names)
            held.append((who + count, place, h))
            count += n
            total += len(h)
            if total > _FLUSH_MARKS:
                yield flush()
                held.clear()
                base, count, total = base + count, 0, 0
        if total:
            yield flush()

    return texts.select("text", "rank", "sha").mapInArrow(run, "bucket long, base long, rank long, sha binary, marks binary")


def _shared_marks(runs: DataFrame, n_parts: int) -> DataFrame:
    """Names of texts, passed on, and packed marks (``which, places``) whose piece is in two texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        names = ["base", "rank", "sha", "which", "places"]
        h, who, place = [], [], []
        for b in batches:
            t = pa.Table.from_batches([b])
            named = t.filter(pa.compute.is_valid(t["sha"]))
            if named.num_rows:
                none = pa.nulls(named.num_rows, pa.binary())
                yield from pa.table([named["base"], named["rank"], named["sha"], none, none], names=names).to_batches()
            rest = t.filter(pa.compute.is_valid(t["marks"]))
            for bucket, base, data in zip(*(rest[c].to_pylist() for c in ("bucket", "base", "marks")), strict=True):
                low, w, p = _unpacked(data, np.uint32, np.uint32, np.uint32)
                h.append(low.astype(np.uint64) | np.uint64(bucket << 32))
                who.append(w + np.int64(base))
                place.append(p)
        if not h:
            return
        h, who, place = np.concatenate(h), np.concatenate(who), np.concatenate(place)
        by = np.argsort(h)
        h = h[by]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        del h
        dealt = who[by]
        low, high = np.minimum.reduceat(dealt, at), np.maximum.reduceat(dealt, at)
        del dealt
        keep = by[np.repeat(low < high, np.diff(np.append(at, len(by))))]
        who, place = who[keep], place[keep]
        if len(who):
            by = np.argsort(who, kind="stable")
            who, place = who[by], place[by]
            edge = np.flatnonzero(np.concatenate(([True], (who[1:] >> 12) != (who[:-1] >> 12), [True])))  # by blocks of 4096 texts
            none = len(edge) - 1
            blocks = [(a, z) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(who[edge[:-1]] >> 12 << 12), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array([(who[a:z] & 4095).astype(np.uint16).tobytes() for a, z in blocks], pa.binary()), pa.array([place[a:z].tobytes() for a, z in blocks], pa.binary())], names=names)

    return runs.repartition(n_parts, "bucket").mapInArrow(run, "base long, rank long, sha binary, which binary, places binary")


def _by_text(found: DataFrame, n_parts: int) -> DataFrame:
    """``uid, places`` of each text with shared marks, places ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        who, place = [], []
        for b in batches:
            for base, w, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                who.append(np.frombuffer(w, np.uint16) + np.int64(base))
                place.append(np.frombuffer(p, np.uint32))
        if not who:
            return
        who, place = np.concatenate(who), np.concatenate(place)
        by = np.lexsort((place, who))
        who, place = who[by], place[by]
        edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True])))
        yield pa.RecordBatch.from_arrays([pa.array(who[edge[:-1]]), pa.array([place[a:z].tobytes() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())], names=["uid", "places"])

    return found.filter("which is not null").select("base", "which", "places").repartition(n_parts, "base").mapInArrow(run, "uid long, places binary")


def _columns(rows: np.ndarray) -> list[np.ndarray]:
    """Big-endian 64-bit columns of byte rows, first column first."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the row before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _dealt(uid, start, end, n_dest: int) -> Iterator[pa.RecordBatch]:
    """Intervals packed by the place that gathers their text."""
    dest = (mix((uid >> 12).astype(np.uint64)) % np.uint64(n_dest)).astype(np.int64)  # blocks of all input partitions over all places
    by = np.argsort(dest, kind="stable")
    uid, start, end, dest = uid[by], start[by], end[by], dest[by]
    edge = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True]))) if len(dest) else np.zeros(1, np.int64)
    cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    if cuts:
        packed = [np.column_stack([uid[a:z], start[a:z], end[a:z]]).astype(np.int64).tobytes() for a, z in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(dest[edge[:-1]], pa.int64()), pa.array(packed, pa.binary())] + [pa.nulls(len(cuts), pa.binary())] * 2, names=_RUN)


_RUN = ["bucket", "intervals", "suffixes", "owners"]


def _pressed(texts: DataFrame) -> DataFrame:
    """``text, sha`` with compressed texts: they are dealt once more, and half the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(press, b.column(0).to_pylist()), pa.binary()), b.column(1)], names=["text", "sha"])

    return texts.select("text", "sha").mapInArrow(run, "text binary, sha binary")


def _suffix_runs(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Front-coded sorted runs of suffixes at shared marks, and the intervals settled inside the task.

    ``suffixes`` holds common prefix lengths, reversed bytes before the mark with
    the lengths of both sides, and the bytes after the common prefixes; ``owners``
    rank, text and place of each suffix.
    """
    before = length - K
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        right, left, sides, owner = (np.concatenate(c) for c in zip(*parts, strict=True))
        r, lf = _columns(right), _columns(left)
        by = np.lexsort((owner[:, 1], owner[:, 0], sides[:, 1], sides[:, 0], *lf[::-1], *r[::-1]))
        right, left, sides, owner = right[by], left[by], sides[by], owner[by]
        new = np.zeros(len(by), bool)
        new[0] = True
        for c in (*r, *lf):
            c = c[by]
            new[1:] |= c[1:] != c[:-1]
        new[1:] |= (sides[1:] != sides[:-1]).any(1)
        least = owner[new, 0][np.cumsum(new) - 1]  # rows of one context are sorted by rank
        done = owner[:, 0] > least  # a document before has all that stands around the mark
        yield from _dealt(owner[done, 1], owner[done, 2] - sides[done, 0], owner[done, 2] + sides[done, 1], buckets)
        go = ~done  # the places of the first document stand for a context
        right, left, sides, owner = right[go], left[go], sides[go], owner[go]
        c = _columns(right[:, :K])
        bucket = (mix(mix(c[0]) + c[1]) >> bits).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
        out = []
        for i in np.flatnonzero(np.diff(edge)).tolist():
            own = by[edge[i] : edge[i + 1]]
            rows = right[own]
            prefix = _common(rows)
            tails = rows[np.arange(length) >= prefix[:, None]]
            body = np.hstack([prefix.astype(np.uint8)[:, None], left[own], sides[own].astype(np.uint8)])
            out.append((i, None, len(own).to_bytes(4, "little") + _packed(body, tails), _packed(*owner[own].T)))
        kinds = [pa.int64()] + [pa.binary()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        parts, held = [], 0
        unpress = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, 1 << 20):
            for text, places, rank, uid in zip(*(b.column(c).to_pylist() for c in ("text", "places", "rank", "uid")), strict=True):
                text = unpress(text)
                every = np.frombuffer(places, np.uint32).astype(np.int64)
                padded = np.concatenate([np.zeros(before, np.uint8), np.frombuffer(text, np.uint8), np.zeros(length, np.uint8)])
                for at in range(0, len(every), _FLUSH_SUFFIXES):
                    p = every[at : at + _FLUSH_SUFFIXES]
                    right = padded[p[:, None] + (before + np.arange(length))]
                    left = padded[p[:, None] + (before - 1 - np.arange(before))]
                    sides = np.column_stack([np.minimum(p, before), np.minimum(len(text) - p, length)])
                    parts.append((right, left, sides, np.column_stack([np.full(len(p), rank), np.full(len(p), uid), p])))
                    held += len(p)
                    if held >= _FLUSH_SUFFIXES:
                        yield from settle(parts)
                        parts, held = [], 0
        if held:
            yield from settle(parts)

    kinds = ", ".join(f"{c} binary" for c in _RUN[1:])
    return rows.select("text", "places", "rank", "uid").mapInArrow(run, f"bucket long, {kinds}")


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings of one length, common prefix lengths) by a loser tree.

    Returns the order as (run, index) and the common prefix length of each
    string with the one before. The head of each run carries its common prefix
    with the last output; of two heads the one with the longer prefix is smaller,
    and only heads with equal prefixes are compared, from that prefix on.
    """
    k = len(runs)
    if k == 1:
        return [(0, i) for i in range(len(runs[0][0]))], list(runs[0][1])
    size = 1 << (k - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (size - k)
    prefixes = [r[1] for r in runs] + [[]] * (size - k)
    at = [0] * size
    head = [s[0] if s else b"" for s in strings]
    known = [0 if s else -1 for s in strings]
    tree = [0] * size  # losers; tree[0] is the winner
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets the loser's prefix with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = head[a][ka:], head[b][ka:]
        if x == y:
            known[b] = ka + len(x)
            return a, b
        same = len(x) - ((number(x) ^ number(y)).bit_length() + 7) // 8
        if x < y:
            known[b] = ka + same
            return a, b
        known[a] = ka + same
        return b, a

    winners = list(range(size))
    level = size
    nodes = [0] * size + winners
    while level > 1:
        for i in range(level // 2, level):
            w, loser = play(nodes[2 * i], nodes[2 * i + 1])
            nodes[i], tree[i] = w, loser
        level //= 2
    win = nodes[1]
    order: list[tuple[int, int]] = []
    common: list[int] = []
    while known[win] >= 0:
        i = at[win]
        order.append((win, i))
        common.append(known[win])
        i += 1
        at[win] = i
        own = strings[win]
        if i < len(own):
            head[win] = own[i]
            known[win] = prefixes[win][i]
        else:
            known[win] = -1
        node = (win + size) >> 1
        while node:
            other = tree[node]
            ka, kb = known[win], known[other]
            if ka < kb:
                tree[node], win = win, other
            elif ka == kb and ka >= 0:
                win, tree[node] = play(win, other)
            node >>= 1
    return order, common


def _intervals(merged: np.ndarray, left: np.ndarray, sides: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in merged order: which are over a string of an earlier document, and how far it reaches before and after the mark.

    With ``a`` bytes before the mark and ``length - a`` after it, equal strings
    have the same class of right side and of left side.
    """
    n, before = len(merged), left.shape[1]
    by = np.lexsort(_columns(left)[::-1])
    common_left = np.empty(n, np.int64)
    common_left[by] = _common(left[by])
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    most, least = np.full(n, -1), np.full(n, length)
    for a in range(before + 1):
        fits = (sides[:, 0] >= a) & (sides[:, 1] >= length - a)
        if not fits.any():
            continue
        r = np.cumsum(merged < length - a)
        lc = np.cumsum((common_left[by] < a))[place] if a else np.zeros(n, np.int64)
        key = (r * (n + 1) + lc)[fits]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        own = rank[fits]
        lows = np.minimum.reduceat(own[order], edge)
        low = np.empty(len(key), np.int64)
        low[order] = np.repeat(lows, np.diff(np.append(edge, len(key))))
        hit = np.flatnonzero(fits)[own > low]
        most[hit] = a
        least[hit] = np.minimum(least[hit], a)
    found = most >= 0
    return found, most[found], length - least[found]


def _merged(runs: DataFrame, length: int, buckets: int, n_parts: int) -> DataFrame:
    """Packed intervals, settled or found by merging the runs of each bucket."""
    before = length - K

    def merge(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        decoded, left, owner = [], [], []
        for suffixes, own in group:
            n = int.from_bytes(suffixes[:4], "little")
            raw = zstandard.ZstdDecompressor().decompress(suffixes[4:])
            body = np.frombuffer(raw, np.uint8, n * (before + 3)).reshape(n, -1)
            strings, at, now = [], n * (before + 3), b""
            lens = body[:, 0].tolist()
            for p in lens:
                z = at + length - p
                now = now[:p] + raw[at:z]
                strings.append(now)
                at = z
            decoded.append((strings, lens))
            left.append(body[:, 1:])
            owner.append(np.column_stack(_unpacked(own, np.int64, np.int64, np.int64)))
        order, common = merge_runs(decoded)
        offset = np.cumsum([0] + [len(x) for x in owner])
        o = np.array(order, np.int64)
        at = offset[o[:, 0]] + o[:, 1]
        ends, own = np.concatenate(left)[at], np.concatenate(owner)[at]
        found, back, ahead = _intervals(np.array(common), ends[:, :before], ends[:, before:].astype(np.int64), own[:, 0], length)
        own = own[found]
        yield from _dealt(own[:, 1], own[:, 2] - back, own[:, 2] + ahead, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, group = None, []
        for b in batches:
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([row[0]], pa.binary())], names=["bucket", "intervals"])
                    continue
                if bucket != now:
                    if group:
                        yield from _only(merge(group))
                    now, group = bucket, []
                group.append(tuple(row[1:]))
        if group:
            yield from _only(merge(group))

    return runs.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, intervals binary")


def _only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["bucket", "intervals"])


def _spans(intervals: DataFrame, n_parts: int) -> DataFrame:
    """``uid, spans``: maximal covered runs of each text as packed starts and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        rows = [np.frombuffer(x, np.int64).reshape(-1, 3) for b in batches for x in b.column(1).to_pylist()]
        if not rows:
            return
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        uid, start, end = rows.T
        head = np.concatenate(([True], uid[1:] != uid[:-1]))
        group = np.cumsum(head)
        far = int(end.max()) + 1
        reach = np.maximum.accumulate(end + group * far) - group * far
        new = head.copy()
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        uid, start, end = uid[at], start[at], np.maximum.reduceat(end, at)
        edge = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1], [True])))
        packed = [np.column_stack([start[a:z], end[a:z]]).tobytes() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(uid[edge[:-1]]), pa.array(packed, pa.binary())], names=["uid", "spans"])

    return intervals.repartition(n_parts, "bucket").mapInArrow(run, "uid long, spans binary")


def find_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``__sha`` (of the whole text), ``__first`` (smallest id of that text) and ``__spans`` (packed, null if none)."""
    n_parts = partitions(docs)
    buckets = 1 << (4 * n_parts - 1).bit_length()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumns({"__rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__sha": F.unhex(F.sha2(text, 256))})
    firsts = cut(keyed.groupBy("__sha").agg(F.min("__rank").alias("__first"), F.max("__rank").alias("__last"), F.max(F.octet_length(text)).alias("__n")))
    long = keyed.filter(F.octet_length(text) >= length).select(text.alias("text"), F.col("__rank").alias("rank"), F.col("__sha").alias("sha"))
    copied = small(firsts.filter("__last > __first").select(F.col("__sha").alias("sha"), F.col("__first").alias("first")), "sha")
    alone = long.join(copied, "sha", "left").filter("first is null or first = rank").drop("first")
    found = cut(_shared_marks(_mark_runs(alone, length, buckets), n_parts))
    names = found.filter("sha is not null").select(F.col("base").alias("uid"), "rank", "sha")
    places = cut(_by_text(found, n_parts).join(names, "uid"))
    rows = _pressed(alone).join(places.hint("merge"), "sha")
    intervals = _merged(_suffix_runs(rows, length, buckets), length, buckets, n_parts)
    spans = cut(_spans(intervals, n_parts).join(places.select("uid", "sha"), "uid").groupBy(F.col("sha").alias("__sha")).agg(F.min("spans").alias("__spans")))
    marked = keyed.join(small(firsts.filter("__last > __first").select("__sha", "__first"), "__sha"), "__sha", "left").join(small(spans, "__spans"), "__sha", "left")
    return marked.withColumn("__first", F.coalesce("__first", "__rank"))


def _kept(text: bytes, copy: bool, spans: bytes | None, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and runs removed."""
    if copy and len(text) >= length:
        return b"", len(text), 1
    if spans is None:
        return text, 0, 0
    at, parts, gone = 0, [], 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()
    for a, z in pairs:
        parts.append(text[at:a])
        gone += z - a
        at = z
    parts.append(text[at:])
    return b"".join(parts), gone, len(pairs)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Null text is empty. A row without an id stands after all others, and two
    such rows take nothing from each other; rows of the same id neither.
    Repeated rows get the same result. Other columns are ignored.
    """
    marked = find_spans(docs.select("doc_id", "text"), length)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in slices(batches):
            rows = []
            for doc_id, text, sha, copy, spans in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                kept, gone, n = _kept(text, copy, spans, length)
                rows.append((doc_id, len(text), gone, n, hashlib.sha256(kept).hexdigest() if n else sha.hex()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = marked.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "__sha", (F.col("__rank") > F.col("__first")).alias("copy"), "__spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; columns and their order stay.

    Characters that lose only some of their bytes go whole. Rows of which
    nothing but white space is left by removal go; untouched rows stay as they are.
    """
    marked = find_spans(docs, length)
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in slices(batches):
            out, keep = [], []
            for text, copy, spans in zip(*(b.column(c).to_pylist() for c in ("text", "__copy", "__spans")), strict=True):
                if text is None or (spans is None and not copy):
                    out.append(text)
                    keep.append(True)
                    continue
                kept, gone, _ = _kept(text, copy, spans, length)
                out.append(kept.decode(errors="ignore").encode() if gone else text)
                keep.append(not gone or bool(kept.strip()))
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if f.name == "text" else b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields]).filter(pa.array(keep))

    rows = marked.select(*[F.col("text").cast("binary").alias("text") if f.name == "text" else F.col(f.name) for f in fields], (F.col("__rank") > F.col("__first")).alias("__copy"), "__spans")
    return rows.mapInArrow(run, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i::INT + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE m < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS o FROM g),
sp AS (SELECT doc_id, o, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, o),
p AS (SELECT doc_id, o, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY o), 0) AS s, a AS e FROM sp
  UNION ALL SELECT doc_id, 1000000000, max(z), max(n) FROM sp JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * s::INT + 1, 2 * (e - s)::INT), '' ORDER BY o) AS kh FROM p JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM sp GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
