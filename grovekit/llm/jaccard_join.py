"""N-gram Jaccard join by grouped prefix filtering.

1. Every text becomes its set of hashed word n-grams; texts with the same set
   are one unit from here on.
2. Grams in very many sets are found among the lowest hashes and put last in the
   global order (a table of bounded size); a unit's prefix is as long as the
   threshold asks.
3. Prefix grams are exchanged as packed sorted runs by gram; a gram that one
   task finds in many units sends them on as members of a long list, and only
   word of it to the gather of that gram. In a list of one gram, units with the
   same prefix and size stand as one group; pairs of groups are filtered by size
   and by the places of the gram, then expanded to members and verified.
4. In lists of at most ``SMALL`` units the pairs leave as rows. Their shared
   prefix grams are counted and bounded against the overlap that a link needs.
5. Longer lists are cut by size bands into parts of bounded size, and every two
   parts meet in a block. A sieve there collapses units to groups, filters the
   pairs of groups and names the units with a partner left; only their texts are
   sent to the block, which compares whole sets by matrix products and returns a
   spanning forest of the links. This is done for the ``HOMES`` first such grams
   of each unit, then once more for the pairs that share no home, do not lie in
   one component yet, and could share their first gram here.
6. Links are joined to components by alternating stars. Every pair that could
   join two components is compared; a group of near copies costs rows by its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import binary_docs, cut, partitions, slices, text_bytes, trim
from grovekit.llm.graph import components
from grovekit.llm.rolling import word_ngrams

N = 4
PERCENT = 85
SMALL = 16  # units of a list whose pairs leave as rows
HOMES = 3  # first grams of long lists whose blocks a unit visits before all others
BLOCK_UNITS, BLOCK_GRAMS = 1500, 1_500_000  # of one side of a block
DENSE_CELLS = 50_000_000
SIEVE_CELLS = 1_000_000  # of a matrix of pairs of groups
LIST_ROWS = 10_000  # units of one packed row of a long list
LAST = (1 << 63) - 1
HOT_GRAMS = 1 << 20  # at most so many grams are put last
BROADCAST_IDS = 1_000_000
FAN = 64  # partners of a text that one verifying group holds
_FLUSH = 1_000_000  # grams that a task packs at once


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of linked sets of sizes x and y."""
    return -(-percent * (x + y) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for b in slices(batches, 1 << 20):
        yield b.column(0).to_pylist(), word_ngrams([t.lower() for t in text_bytes(b.column(1))], n)


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _digest(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Rows of two kinds: a document with its set's size and key, or a packed run of low grams of one bucket."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        names = ["doc_id", "n", "unit", "bucket", "grams"]
        low: list[np.ndarray] = []
        held, seen = 0, set()

        def flush() -> pa.RecordBatch:
            g = np.sort(np.concatenate(low))
            at = np.searchsorted((g >> bits).astype(np.int64), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            nulls = pa.nulls(len(full), pa.int64())
            return pa.RecordBatch.from_arrays([nulls, nulls, nulls, pa.array(full, pa.int64()), pa.array([g[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())], names=names)

        for ids, sets in _sets(batches, n):
            keys = [_key(s) if len(s) else None for s in sets]
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.int64()), none, pa.nulls(len(ids), pa.binary())], names=names)
            for k, s in zip(keys, sets, strict=True):
                if k is not None and k not in seen:
                    seen.add(k)
                    low.append(s[: prefix_length(len(s), percent) + 8])
                    held += len(low[-1])
            if held > _FLUSH:
                yield flush()
                low.clear()
                seen.clear()
                held = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "doc_id long, n long, unit long, bucket long, grams binary")


def _hot_grams(runs: DataFrame, n_parts: int, small: int) -> np.ndarray:
    """Grams in over ``small`` sets, the commonest last; over a higher power of two if there would be too many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        parts = [np.frombuffer(x, np.uint64) for b in batches for x in b.column(1).to_pylist()]
        if parts:
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            g, c = g[c > small], c[c > small]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c, pa.int64())], names=["gram", "df"])

    found = cut(runs.select("bucket", "grams").repartition(n_parts, "bucket").mapInArrow(count, "gram long, df long"))
    sizes = sorted((r["k"], r["count"]) for r in found.groupBy(F.floor(F.log2("df")).alias("k")).count().collect())
    total, least = sum(c for _, c in sizes), 0
    while total > HOT_GRAMS:
        k, c = sizes.pop(0)
        total, least = total - c, 2 ** (k + 1)
    t = found.filter(F.col("df") >= least).toPandas().sort_values(["df", "gram"])
    return t["gram"].to_numpy(np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, hot: np.ndarray, n: int, percent: int, buckets: int, small: int) -> DataFrame:
    """Packed runs: by bucket, sorted prefix grams with unit, place, and each unit's size and group.

    A gram in over ``small`` units of one flush is in a long list: its units leave
    as members of that list (``token`` set) and meet nowhere; ``long`` names such
    grams to the task that gathers their bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    names = ["bucket", "token", "grams", "which", "place", "units", "sizes", "groups", "long"]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        last = shared.value
        order = np.argsort(last)
        sorted_hot, rank = last[order], order
        held: list[tuple] = []
        total, seen = 0, set()

        def flush() -> pa.RecordBatch:
            unit = np.array([h[0] for h in held], np.int64)
            size, group = (np.array([h[i] for h in held], t) for i, t in ((1, np.int32), (3, np.int64)))
            lens = [len(h[2]) for h in held]
            g = np.concatenate([h[2] for h in held])
            who = np.repeat(np.arange(len(held)), lens)
            place = np.concatenate([np.arange(k) for k in lens]).astype(np.int32)
            by = np.argsort(g, kind="stable")
            g, who, place = g[by], who[by], place[by]
            edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            many = np.diff(edge)
            rows = []
            for a, k in zip(edge[:-1][many > small].tolist(), many[many > small].tolist(), strict=True):
                for low in range(a, a + k, LIST_ROWS):
                    own, at = who[low : min(low + LIST_ROWS, a + k)], place[low : min(low + LIST_ROWS, a + k)]
                    spread = int(unit[own[0]]) % buckets
                    rows.append((spread, int(g[a : a + 1].view(np.int64)[0]), None, None, at.tobytes(), unit[own].tobytes(), size[own].tobytes(), group[own].tobytes(), None))
            long = g[edge[:-1][many > small]]
            rest = np.repeat(many <= small, many)
            g, who, place = g[rest], who[rest], place[rest]
            at = np.searchsorted((g >> bits).astype(np.int64), np.arange(buckets + 1))
            told = np.searchsorted((long >> bits).astype(np.int64), np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(at) + np.diff(told)):
                a, z = at[i], at[i + 1]
                own, which = np.unique(who[a:z], return_inverse=True)
                rows.append((int(i), None, g[a:z].tobytes(), which.astype(np.int32).tobytes(), place[a:z].tobytes(), unit[own].tobytes(), size[own].tobytes(), group[own].tobytes(), long[told[i] : told[i + 1]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for _, sets in _sets(batches, n):
            for s in sets:
                if not len(s):
                    continue
                key, p = _key(s), prefix_length(len(s), percent)
                if key in seen:
                    continue
                seen.add(key)
                if len(sorted_hot):
                    at = np.minimum(np.searchsorted(sorted_hot, s), len(sorted_hot) - 1)
                    is_hot = sorted_hot[at] == s
                    cold = s[~is_hot]
                    head = cold[:p]
                    if len(head) < p:
                        head = np.concatenate([head, last[np.sort(rank[at[is_hot]])[: p - len(head)]]])
                else:
                    head = s[:p]
                held.append((key, len(s), head, xxhash.xxh3_64_intdigest(head.tobytes(), len(s)) - (1 << 63)))
                total += p
            if total > _FLUSH:
                yield flush()
                held.clear()
                seen.clear()
                total = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket long, token long, " + ", ".join(f"{x} binary" for x in names[2:]))


def _close(size_a, size_b, place_a, place_b, percent: int, first: bool = False) -> np.ndarray:
    """Whether sizes and the places of a shared prefix gram still allow a link; as the first shared gram, if ``first``."""
    big, small = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    most = np.minimum(size_a - place_a, size_b - place_b)
    if not first:
        most = most + np.minimum(place_a, place_b)
    return (100 * small >= percent * big) & (np.minimum(most, small) >= needed(size_a, size_b, percent))


_PAIRS = "a long, b long, shared int, lack int, token long, units binary, sizes binary, places binary, groups binary"


def _pairs(runs: DataFrame, percent: int, n_parts: int, small: int) -> DataFrame:
    """Candidate pairs of units with the shared prefix grams seen in short lists and those a link needs, and the members of long lists (``token`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        cols: list[list] = [[] for _ in range(6)]
        told = [np.zeros(0, np.uint64)]
        base = 0
        kinds = (np.uint64, np.int32, np.int32, np.int64, np.int32, np.int64)
        names = ["a", "b", "shared", "lack", "token", "units", "sizes", "places", "groups"]

        def listed(token: pa.Array, *packed: pa.Array) -> pa.RecordBatch:
            long, few = pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int32())
            return pa.RecordBatch.from_arrays([long, long, few, few, token, *packed], names=names)

        for b in batches:
            at_once = pa.compute.is_valid(b.column("token"))
            ready, b = b.filter(at_once), b.filter(pa.compute.invert(at_once))
            if ready.num_rows:
                yield listed(*(ready.column(c) for c in ("token", "units", "sizes", "place", "groups")))
            told += [np.frombuffer(x, np.uint64) for x in b.column("long").to_pylist()]
            for row in zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True):
                part = [np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True)]
                part[1] = part[1] + base
                base += len(part[3])
                for c, x in zip(cols, part, strict=True):
                    c.append(x)
        if not base:
            return
        g, who, place, unit, size, group = (np.concatenate(c) for c in cols)
        size = size.astype(np.int64)
        # One entry for each gram and unit: copies met in other tasks fall together.
        by = np.lexsort((unit[who], group[who], g))
        g, who, place = g[by], who[by], place[by].astype(np.int64)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (unit[who[1:]] != unit[who[:-1]])
        g, who, place = g[new], who[new], place[new]
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        length = np.diff(edge)
        # Units of one list with the same prefix and size are one group: its first row and its members.
        head = np.concatenate(([True], (g[1:] != g[:-1]) | (group[who[1:]] != group[who[:-1]])))
        first = np.flatnonzero(head)
        members = np.diff(np.append(first, len(g)))
        groups = np.add.reduceat(head, edge[:-1])  # of each list
        at_group = np.cumsum(head)[edge[:-1]] - 1
        few = (length <= small) & ~np.isin(g[edge[:-1]], np.concatenate(told))
        left, right = [], []
        for k in np.unique(groups[few & (length > 1)]).tolist():
            lists = at_group[few & (length > 1) & (groups == k)][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            x, y = lists[:, i].ravel(), lists[:, j].ravel()
            ok = _close(size[who[first[x]]], size[who[first[y]]], place[first[x]], place[first[y]], percent)
            x, y = x[ok], y[ok]
            many = members[x] * members[y]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(members[y], many)
            left.append(np.repeat(first[x], many) + at // wide)
            right.append(np.repeat(first[y], many) + at % wide)
            own = lists.ravel()
            for m in np.unique(members[own][members[own] > 1]).tolist():
                rows = first[own[members[own] == m]][:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                left.append(rows[:, i].ravel())
                right.append(rows[:, j].ravel())
        out: list[pa.RecordBatch] = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            x, y = who[x], who[y]
            p, q = unit[x], unit[y]
            x, y, p, q = np.where(p < q, x, y), np.where(p < q, y, x), np.minimum(p, q), np.maximum(p, q)
            if not len(x):
                return
            by = np.lexsort((q, p))
            x, y, p, q = x[by], y[by], p[by], q[by]
            at = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            seen = np.diff(np.append(at, len(p)))
            x, y, p, q = x[at], y[at], p[at], q[at]
            rest = np.maximum(size[x] - prefix_length(size[x], percent), size[y] - prefix_length(size[y], percent))
            lack = needed(size[x], size[y], percent) - rest
            none = pa.nulls(len(p), pa.binary())
            out.append(pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(seen, pa.int32()), pa.array(lack, pa.int32()), pa.nulls(len(p), pa.int64()), *[none] * 4], names=names))

        if left:
            keep(np.concatenate(left), np.concatenate(right))
        for a, k in zip(edge[:-1][~few].tolist(), length[~few].tolist(), strict=True):
            for at in range(a, a + k, LIST_ROWS):
                part = np.arange(at, min(at + LIST_ROWS, a + k))
                one = lambda x: pa.array([x.tobytes()], pa.binary())
                out.append(listed(pa.array(g[a : a + 1].view(np.int64)), one(unit[who[part]]), one(size[who[part]].astype(np.int32)), one(place[part].astype(np.int32)), one(group[who[part]])))
        yield from out

    return runs.repartition(n_parts, "bucket").mapInArrow(run, _PAIRS)


def _members(lists: DataFrame) -> DataFrame:
    """``token, unit, size, place, set_group`` of the units in long lists."""
    kinds = (("unit", np.int64), ("size", np.int32), ("place", np.int32), ("set_group", np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in batches:
            for token, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                cols = [np.frombuffer(x, k) for x, (_, k) in zip(row, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), token)), *map(pa.array, cols)], names=["token", *(c for c, _ in kinds)])

    rows = lists.select("token", "units", "sizes", "places", "groups").mapInArrow(run, "token long, unit long, size int, place int, set_group long")
    return rows.dropDuplicates(["token", "unit"])  # a unit that several tasks have met


def _dealt(rows: DataFrame, percent: int) -> DataFrame:
    """Rows ``token, unit, size`` at every block they meet in: ``band, guest, part, i, j``.

    A token's units are cut by bands of size, and visit the next band as guests;
    bands are dealt to parts of bounded units and grams, and every two parts meet once.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = rows.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", band + F.col("guest").cast("int"))
    sizes = rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"))
    deals = F.ceil(F.greatest(F.col("m") / BLOCK_UNITS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    wide = cut(sizes.select("token", "band", deals.alias("deals")).filter("deals > 1"))  # only these are cut, and they are few
    if wide.count() <= BROADCAST_IDS:
        wide = F.broadcast(wide)
    rows = rows.join(wide, ["token", "band"], "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("unit"), F.col("deals")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("deals", "other")


def _sieve(rows: DataFrame, percent: int, first: bool) -> DataFrame:
    """Those of the dealt rows that have a partner in their block.

    Units of one prefix and size are one group; pairs of groups are filtered by
    sizes and places, and by having no home in common (``homes``). A unit stays if
    a group that passes holds a unit of another component (``component``).
    """
    kept = ["token", "band", "i", "j", "unit", "guest", "part"]

    def sieve(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        part, guest, group, comp = (table[c].to_numpy() for c in ("part", "guest", "set_group", "component"))
        size, place = (table[c].to_numpy().astype(np.int64) for c in ("size", "place"))
        homes = table["homes"].combine_chunks()
        offsets, home = homes.offsets.to_numpy(), homes.values.to_numpy(zero_copy_only=False)
        stays = np.zeros(len(part), bool)
        sides = []
        for p in (i, j) if i != j else (i,):
            own = np.flatnonzero(part == p)
            _, one, which = np.unique(group[own], return_index=True, return_inverse=True)
            lo, hi = np.full(len(one), LAST), np.full(len(one), -LAST)
            np.minimum.at(lo, which, comp[own])
            np.maximum.at(hi, which, comp[own])
            at = own[one]
            visits = np.full((len(at), HOMES), 0)
            for row, x in enumerate(at.tolist()):
                mine = home[offsets[x] : offsets[x + 1]]
                visits[row, : len(mine)] = mine
            sides.append((own, which, at, lo, hi, visits))
        for a, b in ((0, -1), (-1, 0)) if i != j else ((0, 0),):
            own, which, at, lo, hi, visits = sides[a]
            _, _, to, lo_b, hi_b, visits_b = sides[b]
            step = max(1, SIEVE_CELLS // max(1, len(to)))
            by = np.argsort(which, kind="stable")
            edge = np.searchsorted(which[by], np.arange(len(at) + 1))
            for low in range(0, len(at), step):
                high = min(low + step, len(at))
                x = at[low:high]
                ok = _close(size[x][:, None], size[to][None], place[x][:, None], place[to][None], percent, first)
                ok &= ~(guest[x][:, None] & guest[to][None])
                for h in range(HOMES):
                    mine = visits[low:high, h][:, None]
                    for other in range(HOMES):
                        ok &= (mine != visits_b[:, other][None]) | (mine == 0)
                # The components that a group's partners span.
                least = np.where(ok, lo_b[None], LAST).min(1)
                most = np.where(ok, hi_b[None], -LAST).max(1)
                rows = by[edge[low] : edge[high]]
                mine = comp[own[rows]]
                stays[own[rows]] |= ok.any(1)[which[rows] - low] & ((least[which[rows] - low] != mine) | (most[which[rows] - low] != mine))
        return table.filter(pa.array(stays)).select(kept)

    return rows.groupBy("token", "band", "i", "j").applyInArrow(sieve, "token long, band int, i int, j int, unit long, guest boolean, part int")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64)
    lens = [len(x) for x in (*left, *right)]
    grams, column, many = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    common = many > 1
    if common.sum() * len(lens) > DENSE_CELLS:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    rank = np.cumsum(common) - 1
    who = np.repeat(np.arange(len(lens)), lens)
    keep = common[column]
    who, column = who[keep], rank[column[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    for low in range(0, int(common.sum()), 2048):
        a, z = np.searchsorted(column, (low, low + 2048))
        m = np.zeros((len(lens), 2048), np.float32)
        m[who[a:z], column[a:z] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _forest(adjacent: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    new, a, b = np.ones(len(adjacent), bool), [], []
    for root in range(len(adjacent)):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(adjacent[u] & new)
            new[found] = False
            a += [u] * len(found)
            b += found.tolist()
            queue += found.tolist()
    return a, b


def _blocks(docs: DataFrame, units: DataFrame, visits: DataFrame, n: int, percent: int, n_parts: int) -> DataFrame:
    """A spanning forest of links ``a, b`` of each block of the sieved rows."""
    ids = cut(units.join(visits, "unit").select(F.col("rep").alias("doc_id"), "unit", "token", "band", "guest", "part", "i", "j"))
    keys = ["token", "band", "i", "j"]
    dealt = _texts_of(docs, ids).repartition(n_parts, *keys).sortWithinPartitions(*keys, "unit")

    def compare(group: list[tuple]) -> pa.RecordBatch:
        i, j = group[0][0][2:]
        unit, part = np.array([g[1] for g in group]), np.array([g[2] for g in group])
        guest, sets = np.array([g[3] for g in group]), [g[4] for g in group]
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        size = np.array([len(s) for s in sets])
        both = _overlaps([sets[x] for x in left], [sets[x] for x in right])
        ok = 100 * both >= percent * (size[left][:, None] + size[right][None] - both)
        ok &= ~(guest[left][:, None] & guest[right][None]) & (unit[left][:, None] != unit[right][None])
        adjacent = np.zeros((len(unit), len(unit)), bool)
        adjacent[np.ix_(left, right)] = ok
        a, b = _forest(adjacent | adjacent.T)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(unit[a], unit[b]) if a else [], pa.int64()), pa.array(np.maximum(unit[a], unit[b]) if a else [], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, group = None, []
        for b in slices(batches, 1 << 20):
            sets = word_ngrams([t.lower() for t in text_bytes(b.column("text"))], n)
            for s, unit, part, guest, *key in zip(sets, *(b.column(c).to_pylist() for c in ("unit", "part", "guest", *keys)), strict=True):
                if not len(s) or _key(s) != unit:  # another text under the same id
                    continue
                if key != now:
                    if len(group) > 1:
                        yield compare(group)
                    now, group = key, []
                group.append((key, unit, part, guest, s))
        if len(group) > 1:
            yield compare(group)

    return dealt.select("text", "unit", "part", "guest", *keys).mapInArrow(run, "a long, b long").distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (with ``doc_id``) with their texts; few ids are broadcast before the texts are dealt."""
    wanted = ids.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id", "left_semi").join(ids, "doc_id")


def _verify(docs: DataFrame, units: DataFrame, pairs: DataFrame, n: int, percent: int, n_parts: int) -> DataFrame:
    """Those of the pairs of units ``a, b`` that are linked, by the sets of their whole texts."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / FAN)).cast("int"))
    sides = dealt.select(F.explode(F.array(F.struct(F.col("a").alias("unit"), "a", "salt", F.lit(0).alias("side")), F.struct(F.col("b").alias("unit"), "a", "salt", F.lit(1).alias("side")))).alias("s")).select("s.*").distinct()
    ids = cut(units.join(sides, "unit").select(F.col("rep").alias("doc_id"), "unit", "a", "salt", "side"))
    rows = _texts_of(docs, ids).repartition(n_parts, "a", "salt").sortWithinPartitions("a", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        mine, now = None, None
        for b in slices(batches, 1 << 20):
            sets = word_ngrams([t.lower() for t in text_bytes(b.column("text"))], n)
            a_out, b_out = [], []
            for s, unit, a, salt, side in zip(sets, *(b.column(c).to_pylist() for c in ("unit", "a", "salt", "side")), strict=True):
                if not len(s) or _key(s) != unit:  # another text under the same id
                    continue
                if side == 0:
                    mine, now = s, (a, salt)
                elif now == (a, salt):
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        a_out.append(a)
                        b_out.append(unit)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return cut(rows.select("text", "unit", "a", "salt", "side").mapInArrow(run, "a long, b long").distinct())


def _buckets(n_parts: int) -> int:
    """A power of two of at least four buckets for each partition."""
    return 1 << (4 * n_parts - 1).bit_length()


def link(docs: DataFrame, n: int = N, percent: int = PERCENT, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (``doc_id, n, unit``), units (``unit, rep``) and verified links of units (``a, b``) that span all components."""
    spark = docs.sparkSession
    n_parts = partitions(docs)
    buckets = _buckets(n_parts)
    texts = binary_docs(docs)
    digest = cut(_digest(texts, n, percent, buckets))
    each = digest.filter("bucket is null").select("doc_id", "n", "unit")
    units = cut(each.filter("unit is not null and doc_id is not null").groupBy("unit").agg(F.min("doc_id").alias("rep")))
    known = texts.filter("doc_id is not null")
    hot = _hot_grams(digest.filter("bucket is not null"), n_parts, small)
    found = cut(_pairs(_prefixes(known, hot, n, percent, buckets, small), percent, n_parts, small))
    lists = found.filter("token is not null")
    members = cut(_members(lists))
    long = members.groupBy("unit").agg(F.count(F.lit(1)).alias("k"))  # prefix grams of a unit that pairs were not counted by
    side = lambda c: long.select(F.col("unit").alias(c), F.col("k").alias(f"k{c}"))
    counted = found.filter("token is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("lack").alias("lack"))
    unseen = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    counted = cut(counted.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.col("shared") + unseen >= F.col("lack")).select("a", "b"))
    links = _verify(known, units, counted, n, percent, n_parts)
    if not members.isEmpty():
        first = F.slice(F.array_sort(F.collect_list(F.struct("place", "token"))), 1, HOMES)
        homes = cut(members.groupBy("unit", "size", "set_group").agg(first.alias("first")))
        visits = homes.select("unit", "size", "set_group", F.explode("first").alias("t")).select("unit", "size", "set_group", "t.place", "t.token")
        none = F.array().cast("array<long>")
        sieved = _sieve(_dealt(visits.withColumns({"component": F.col("unit"), "homes": none}), percent), percent, first=False)
        links = cut(links.unionByName(_blocks(known, units, sieved, n, percent, n_parts)))
        of = components(links).select(F.col("node").alias("unit"), "component")
        told = homes.select("unit", F.col("first.token").alias("homes")).join(of, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
        sieved = cut(_sieve(_dealt(members.join(told, "unit"), percent), percent, first=True))
        if not sieved.isEmpty():
            links = links.unionByName(_blocks(known, units, sieved, n, percent, n_parts))
    return each, units, links


def join_components(docs: DataFrame, n: int = N, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Texts link when their sets of word n-grams (A-Z lower-cased) overlap by at
    least ``percent`` of their union. Texts without words are linked with
    nothing. Rows with the same id are one document of several texts. A null id
    is linked with nothing and has a null component. Sets are compared by 64-bit
    hashes of their grams, and units known by a 64-bit hash of their set.
    """
    each, units, links = link(docs, n, percent, small)
    reps = links.join(units.select(F.col("unit").alias("a"), F.col("rep").alias("ra")), "a").join(units.select(F.col("unit").alias("b"), F.col("rep").alias("rb")), "b")
    edges = reps.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    own = each.filter("unit is not null and doc_id is not null").join(units, "unit").select("doc_id", "n", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id")
    more = own.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of = components(edges.unionByName(more))
    rows = each.join(units, "unit", "left").withColumn("node", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("rep", "doc_id")))
    return rows.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.far = e.x)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.far) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
