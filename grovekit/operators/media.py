"""Links between text chunks, media and entities."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from grovekit.functions import text as T
from grovekit.operators.merging import broadcast_small
from grovekit.sources.checkpoints import cut

LINK_PAGE, LINK_ORDER, LINK_MENTION = (T.LINK_WEIGHTS[x] for x in ("page", "order", "mention"))


CHUNK_BLOCK, MEDIA_BLOCK = 250_000, 1_000  # chunks and media of one group, where a document has more


def link_media(chunks: DataFrame, media: DataFrame, window: int = 1, k: int = 3, similarity: Column | None = None) -> DataFrame:
    """``media_id, chunk_id, score`` of the best ``k`` chunks of each medium, in each document.

    Pages are met within the window; chunks or media without a page meet all of
    their document. Without a ``similarity`` of the pair, chunks that may be among
    the best are looked up and not every pair is formed.
    """
    counted = chunks.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")), "doc_id")
    c = counted.select("doc_id", "chunk_id", F.col("page_start").alias("c_page"), F.col("order").alias("c_order"), "n_chunks", T.names_kind("text", T.IMAGE_KEYWORDS).alias("c_image"), T.names_kind("text", T.TABLE_KEYWORDS).alias("c_table"), T.word_set("text").alias("c_words"))
    m = media.select("doc_id", "media_id", F.col("page").alias("m_page"), "media_index", T.word_set("media_text").alias("m_words"), "modality")
    if similarity is None:
        rows, similarity, mention = _candidates(c, m, window, k), F.lit(0.0), F.col("mention")
    else:
        near = m.filter("m_page is not null").withColumn("c_page", F.explode(F.sequence(F.col("m_page") - window, F.col("m_page") + window)))
        paged = near.join(c, ["doc_id", "c_page"])
        blank = m.filter("m_page is null").join(c, "doc_id").unionByName(m.filter("m_page is not null").join(c.filter("c_page is null"), "doc_id"))
        rows, mention = paged.select(*blank.columns).unionByName(blank), T.mention_of(*map(F.col, ("c_image", "c_table", "c_words", "m_words", "modality")))
    score = T.link_score(T.page_score(F.col("m_page"), F.col("c_page"), window), similarity, T.order_score(F.col("media_index"), F.col("c_order"), F.col("n_chunks")), mention)
    w = Window.partitionBy("media_id").orderBy(F.desc("score"), "c_order", "chunk_id")
    best = rows.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.filter("score > 0").select("media_id", "chunk_id", "score", "rank")


def _candidates(c: DataFrame, m: DataFrame, window: int, k: int) -> DataFrame:
    """Pairs that hold the best ``k`` chunks of each medium, with their ``mention``.

    Only words that both sides have are kept. A large document's chunks are dealt to
    blocks, its media to buckets by these words, and each block meets each bucket.
    """
    words = m.select("doc_id", F.explode("m_words").alias("w")).distinct()
    listed = c.withColumn("w", F.explode_outer("c_words")).join(broadcast_small(words.withColumn("hit", F.col("w"))), ["doc_id", "w"], "left")
    name = ["doc_id", "chunk_id", "c_page", "c_order", "n_chunks"]
    known = lambda x: F.coalesce(F.col(x), F.lit(True)).alias(x)  # noqa: E731  a null text counts as a full mention
    c = cut(listed.groupBy(*name, known("c_image"), known("c_table")).agg(F.collect_set("hit").alias("c_words")))
    shared = c.select("doc_id", F.explode("c_words").alias("w")).distinct()
    met = m.select("doc_id", "media_id", F.explode("m_words").alias("w")).join(broadcast_small(shared), ["doc_id", "w"]).groupBy("doc_id", "media_id").agg(F.array_sort(F.collect_set("w")).alias("met"))
    whole = F.col("m_words").isNull().alias("whole")  # a null text here, too
    m = cut(m.join(met, ["doc_id", "media_id"], "left").select("doc_id", "media_id", "m_page", "media_index", (F.col("modality") == "image").alias("image"), whole, F.coalesce("met", F.array().cast("array<string>")).alias("met")))
    upto = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nc")).join(m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nm")), "doc_id")
    sizes = cut(sizes.select("doc_id", upto("nc", CHUNK_BLOCK).alias("blocks"), F.least(upto("nm", MEDIA_BLOCK), F.lit(64)).alias("buckets")))
    total = sizes.agg(F.sum(F.col("blocks") * F.col("buckets"))).first()[0] or 1
    parts = min(max(2 * total, 32), 2000)
    key = ["doc_id", "block", "bucket"]
    sized = broadcast_small(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    left = c.join(sized, "doc_id").withColumn("block", own("blocks", "chunk_id")).withColumn("bucket", every("buckets")).drop("blocks", "buckets").repartition(parts, *key)
    right = m.join(sized, "doc_id").withColumn("bucket", own("buckets", "met", "image")).withColumn("block", every("blocks")).drop("blocks", "buckets").repartition(parts, *key)
    fields = {f.name: f for t in (c, m) for f in t.schema}
    out = T_.StructType([fields[x] for x in ("media_id", "chunk_id", "m_page", "c_page", "media_index", "c_order", "n_chunks")] + [T_.StructField("mention", T_.DoubleType())])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_finder(window, k), out)


def _finder(window: int, k: int):
    """Arrow function of one group: for each medium the chunks that may be among its best ``k``.

    Chunks of one page and one mention differ in order alone, so that the nearest on
    both sides are enough, with all whose score is the same to six places, and the
    first of those too far off to have an order score.
    """

    def find(chunks: pa.Table, media: pa.Table) -> pa.Table:
        chunks = chunks.take(pc.sort_indices(chunks, [("c_order", "ascending"), ("chunk_id", "ascending")]))
        n = chunks.num_rows
        order = chunks["c_order"].to_numpy().astype(np.int64)
        page = np.array([-1 if x is None else x for x in chunks["c_page"].to_pylist()], np.int64)
        bare = chunks["c_page"].is_null().to_numpy()
        pages, place = np.unique(page, return_inverse=True)
        place = np.where(bare, len(pages), place)
        number = {int(p): i for i, p in enumerate(pages)}
        named = {True: chunks["c_image"].to_numpy().astype(bool), False: chunks["c_table"].to_numpy().astype(bool)}
        lists = chunks["c_words"].combine_chunks()
        at, held = np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten().dictionary_encode()
        sorts = np.argsort(held.indices.to_numpy(), kind="stable")
        ends = np.searchsorted(held.indices.to_numpy()[sorts], np.arange(len(held.dictionary) + 1))
        posted = {w: at[sorts[ends[i] : ends[i + 1]]] for i, w in enumerate(held.dictionary.to_pylist())}
        total = max(chunks["n_chunks"][0].as_py(), 1) if n else 1
        flat = 1e-6 * total / LINK_ORDER + 2  # orders within which scores may round to the same
        groups: dict = {}
        for i, (words, image, whole) in enumerate(zip(media["met"].to_pylist(), media["image"].to_pylist(), media["whole"].to_pylist(), strict=True)):
            groups.setdefault((tuple(w for w in words if w in posted), bool(image), whole), []).append(i)
        m_page, m_index = media["m_page"].to_pylist(), media["media_index"].to_pylist()
        rows_m, rows_c, rows_s = [], [], []
        for (words, image, whole), members in groups.items() if n else ():
            level = np.zeros(n, np.int64)
            for w in words:
                level[posted[w]] += 1
            level = np.full(n, 20) if whole else np.where(named[image], 20, np.minimum(level, 20))
            cases = {}
            for paged in {m_page[i] is not None for i in members}:
                code = (place * 21 + level) if paged else level
                if code.max() < 1 << 16:
                    code = code.astype(np.uint16)  # sorted by radix
                perm = np.argsort(code, kind="stable")
                keys, starts = np.unique(code[perm], return_index=True)
                cases[paged] = perm, {int(x): (s, e) for x, s, e in zip(keys, starts, [*starts[1:], n], strict=True)}
            for i in members:
                p, t = m_page[i], min(total - 1, m_index[i])
                perm, spans = cases[p is not None]
                if p is None:
                    wanted = [(0.5, 0)]
                else:
                    wanted = [(1.0 - abs(j) / (window + 1), number[p + j]) for j in range(-window, window + 1) if p + j in number] + [(0.5, len(pages))]
                found, scores = [], []
                for score, base in wanted:
                    for lv in range(21):
                        span = spans.get(base * 21 + lv)
                        if span is None:
                            continue
                        ids = perm[span[0] : span[1]]
                        x = _Lazy(order, ids)
                        mid = bisect_left(x, t)
                        lo, hi = max(0, mid - k), min(len(ids), mid + k)
                        near = np.sort(np.abs(order[ids[lo:hi]] - t))
                        reach = near[min(k, len(near)) - 1] + flat
                        lo, hi, far = bisect_left(x, t - reach), bisect_left(x, t + reach + 1), bisect_left(x, t + total)
                        chosen = np.unique(np.concatenate([np.arange(lo, hi), np.arange(min(k, len(ids))), np.arange(far, min(far + k, len(ids)))]))
                        ids = ids[chosen]
                        found.append(ids)
                        near_by = 1.0 if total <= 1 else np.maximum(0.0, 1.0 - np.abs(order[ids] - t) / total)
                        scores.append(LINK_PAGE * score + LINK_ORDER * near_by + LINK_MENTION * (lv / 20.0) + np.zeros(len(ids)))
                if not found:
                    continue
                found, scores = np.concatenate(found), np.concatenate(scores)
                keep = found[scores >= (np.partition(scores, -k)[-k] if len(scores) > k else scores.min()) - 3e-6]
                rows_m.append(np.full(len(keep), i))
                rows_c.append(keep)
                rows_s.append(level[keep] / 20.0)
        one = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        left, right = media.take(pa.array(one(rows_m, np.int64))), chunks.take(pa.array(one(rows_c, np.int64)))
        return pa.table({"media_id": left["media_id"], "chunk_id": right["chunk_id"], "m_page": left["m_page"], "c_page": right["c_page"], "media_index": left["media_index"], "c_order": right["c_order"], "n_chunks": right["n_chunks"], "mention": pa.array(one(rows_s, np.float64), pa.float64())})

    return find


class _Lazy:
    """``order[ids]`` for a binary search, without taking it all."""

    def __init__(self, order: np.ndarray, ids: np.ndarray):
        self.order, self.ids = order, ids

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int):
        return self.order[self.ids[i]]


def entity_media(entities: DataFrame, attached: DataFrame, k: int = 5) -> DataFrame:
    """``entity_name, media_ids``: media of an entity's chunks in order of its source ids, each once, at most ``k``.

    ``attached`` holds ``source_id`` (a chunk's hash or id), ``media_id`` and ``rank``.
    """
    ids = entities.select("entity_name", F.posexplode("source_ids").alias("pos", "source_id"))
    hits = ids.join(attached, "source_id").groupBy("entity_name", "media_id").agg(F.min(F.struct("pos", "rank", "media_id")).alias("o"))
    w = Window.partitionBy("entity_name").orderBy("o")
    top = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    found = top.groupBy("entity_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "media_id"))), lambda x: x["media_id"]).alias("media_ids"))
    return entities.select("entity_name").distinct().join(found, "entity_name", "left").withColumn("media_ids", F.coalesce("media_ids", F.array().cast("array<string>")))


def match_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each document: the same name, else one equal or contained either way without regard to case; the first by name.

    Exact names meet by an equi-join; only the rest is compared with all files of
    the (listed, so bounded) folder.
    """
    exact = docs.join(files, F.col("doc_name") == F.col("file_name")).select("doc_name", "file_name")
    rest = docs.join(exact.select("doc_name"), "doc_name", "left_anti").select("doc_name").distinct()
    d, f = F.lower("doc_name"), F.lower("file_name")
    loose = rest.join(broadcast_small(files), F.contains(d, f) | F.contains(f, d)).groupBy("doc_name").agg(F.min("file_name").alias("file_name"))
    return exact.unionByName(loose)
