"""Benchmark decontamination with DataFrame operations only.

Benchmark texts become a set of hashes of normalised n-gram windows. One scan of
the documents hashes the words of each text, then every token window, and probes
that set, which is broadcast while it is within a bound; beyond it hash, document
and place of each window are joined by hash. Documents with a hit are read once
more and each hit is verified word by word, so hashes decide nothing. Only hits,
and one short row of each document for its number of words, are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import cut, small

N = 8
MIN_ITEMS = 2
BROADCAST_WINDOWS = 1_000_000  # hashes of 8 bytes each
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # before A-Z are lower-cased
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Words in their own case; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{_GAP}+"), lambda x: x != "")


def _folded(words: Column) -> Column:
    return F.transform(words, lambda x: F.translate(x, _UPPER, _LOWER))


def _hashed(words: Column) -> Column:
    """A hash of each word in small letters; words that differ in A-Z alone hash alike."""
    return F.transform(words, lambda x: F.xxhash64(F.lower(x)))


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once for a row, however often ``f`` looks into it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _window(hashes: str, i: Column | int, k: int) -> Column:
    """Hash of the ``k`` word hashes from place ``i``; they are looked up one by one, as a slice would copy the whole array."""
    return F.xxhash64(*[F.get(hashes, F.lit(j) if isinstance(i, int) else i + j) for j in range(k)])


def benchmark_windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``hash, window, item_ids``: the distinct windows of all items.

    Items without an id or without words have no windows.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _folded(_words(F.col(text_col))).alias("w")).filter("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    places = F.sequence(F.lit(0), F.least(F.size("w"), F.lit(n)) - 1)
    each = F.transform(starts, lambda i: F.transform(places, lambda j: F.get("w", i + j)))
    windows = items.select("item", F.explode(each).alias("window")).groupBy("window").agg(F.collect_set("item").alias("item_ids"))
    of = [F.when(F.size("h") == k, _window("h", 0, k)) for k in range(1, n + 1)]
    return windows.withColumn("h", _hashed(F.col("window"))).select(F.coalesce(*of).alias("hash"), "window", "item_ids")


def _probe(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n_words, copies`` of every id and text, and ``doc_id, text_key, s, hash`` of the windows whose hash is known."""
    lengths = sorted(r[0] for r in windows.select(F.size("window")).distinct().collect())  # n of them, at most
    hashes = windows.select(F.col("hash").alias("known")).distinct()
    few = hashes.count() <= BROADCAST_WINDOWS
    h = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), _hashed(_words(F.col(text_col))).alias("h"))
    # The array of hashes is looked into from each exploded row, in generated code that doesn't copy it.
    rows = h.select("doc_id", "text_key", F.size("h").cast("long").alias("n_words"), "h", F.posexplode_outer("h").alias("s", "first"))
    of = [F.when(F.col("s") <= F.col("n_words") - k, _window("h", F.col("s"), k)).alias(f"h{k}") for k in lengths]
    rows = rows.select("doc_id", "text_key", "n_words", "s", *of)
    first = F.coalesce(F.col("s"), F.lit(0)) == 0
    count = lambda df: df.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(first).alias("copies"))
    if not few:
        met = None
        for k in lengths:
            own = rows.select("doc_id", "text_key", "s", F.col(f"h{k}").alias("hash")).filter("hash is not null").join(hashes, F.col("hash") == F.col("known"), "left_semi")
            met = own if met is None else met.unionByName(own)
        return cut(count(rows.filter(first))), met
    for k in lengths:
        rows = rows.join(F.broadcast(hashes.withColumnRenamed("known", f"k{k}")), F.col(f"h{k}") == F.col(f"k{k}"), "left")
    found = F.array_compact(F.array(*[F.col(f"k{k}") for k in lengths])) if lengths else F.array().cast("array<long>")
    kept = rows.filter(first | (F.coalesce(*[F.col(f"k{k}") for k in lengths], F.lit(None).cast("long")).isNotNull()))
    hits = F.when(F.size("found") > 0, F.struct("s", "found"))
    both = kept.select("doc_id", "text_key", "n_words", "s", found.alias("found")).groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(first).alias("copies"), F.collect_set(hits).alias("hits"))
    both = cut(both)
    met = both.filter("size(hits) > 0").select("doc_id", "text_key", F.explode("hits").alias("p")).select("doc_id", "text_key", "p.s", F.explode("p.found").alias("hash"))
    return both.drop("hits"), met


def _verified(docs: DataFrame, places: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    met = places.join(small(windows, "window"), "hash")
    met = cut(met.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "window", "item_ids")).alias("hits")))
    ids = small(met.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "hits"), "hits")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    same = lambda w, x: F.forall(F.sequence(F.lit(0), F.size(x["window"]) - 1), lambda j: F.get(w, x["s"] + j) == F.get(x["window"], j))
    true = _once(_folded(_words(F.col("text"))), lambda w: F.filter("hits", lambda x: same(w, x)))
    found = found.select("doc_id", "text_key", true.alias("hits")).filter("size(hits) > 0")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["s"], x["s"] + F.size(x["window"]) - 1))))
    items = F.array_distinct(F.flatten(F.transform("hits", lambda x: x["item_ids"])))
    return found.select("doc_id", "text_key", covered.alias("hit_words"), items.alias("item_ids")).dropDuplicates(["doc_id", "text_key"])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n_words, copies`` of every id and text, and ``doc_id, text_key, hit_words`` (positions from 0) and ``item_ids`` of those with an occurring window.

    Rows with the same id and text are one row of so many copies. Null ids are an
    id of their own; null text has no words. Without items nothing is found.
    """
    windows = cut(benchmark_windows(benchmark, n))
    rows, places = _probe(docs, windows, id_col, text_col)
    return rows, _verified(docs, places, windows, id_col, text_col)


def _beside(docs: DataFrame, found: DataFrame, payload: str) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``__key``) with what was found in each row's text, or nulls."""
    found = small(cut(found.withColumnRenamed("doc_id", "__id").withColumnRenamed("text_key", "__found")), payload)
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__found")), "left")


def score(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows give a row
    each; an empty table gives none. Other columns are ignored.
    """
    items = F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256)
    rows, found = find_hits(docs, benchmark, n)
    found = found.select("doc_id", "text_key", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"))
    out = _beside(rows.withColumnRenamed("text_key", "__key"), found, "items_sha256").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy").withColumn("contaminated", F.col("n_items") >= min_items)


def remove_spans(text: Column, hit_words: Column) -> Column:
    """The text without the words at the given positions and what follows each up to the next word."""
    lead = F.regexp_extract(text, f"^{_GAP}*", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"({_WORD}+{_GAP}*)"), F.lit(1))
    every = lambda p: F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    rest = _once(pieces, lambda p: F.array_join(F.transform(F.array_except(every(p), hit_words), lambda i: F.get(p, i)), ""))
    return F.concat(lead, rest)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` without contaminated documents; in documents with fewer items, hit spans are removed.

    All columns and their order stay. Documents without hits, and null texts, are
    untouched; repeated rows are treated alike; an empty table stays empty.
    """
    found = find_hits(docs, benchmark, n)[1].select("doc_id", "text_key", F.col("hit_words").alias("__hit"), F.size("item_ids").alias("__n"))
    joined = _beside(docs.withColumn("__key", F.xxhash64("text")), found, "__hit")
    kept = joined.filter(F.coalesce("__n", F.lit(0)) < min_items)
    text = F.when(F.col("__n").isNull(), F.col("text")).otherwise(remove_spans(F.col("text"), F.col("__hit")))
    return kept.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 7) AS g, least(len(w), 8) AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, ks)),
h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
