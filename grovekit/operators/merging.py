"""Merging of entities and relations; order is by an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text as T
from grovekit.models import ask

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows and ``size`` bytes; else joins shuffle it."""
    width = F.octet_length(F.to_json(F.struct("*")))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def merge_entities(rows: DataFrame, order: list[str], separator: str = " | ", id_cap: int | None = None) -> DataFrame:
    """One row of each name: descriptions joined in order, distinct source ids in order, the first type.

    Equal descriptions and ids are folded by name before anything is gathered, so
    that a common name costs its distinct values only.
    """
    first = F.min(F.struct(*order))
    texts = rows.groupBy("entity_name", "description").agg(first.alias("o"))
    texts = texts.groupBy("entity_name").agg(F.array_sort(F.collect_list(F.struct("o", "description"))).alias("d"))
    ids = rows.groupBy("entity_name", "source_id").agg(first.alias("o"))
    ids = ids.groupBy("entity_name").agg(F.array_sort(F.collect_list(F.struct("o", "source_id"))).alias("i"))
    kinds = rows.groupBy("entity_name").agg(F.min_by("entity_type", F.struct(*order)).alias("entity_type"), F.count(F.lit(1)).alias("mentions"))
    source_ids = F.transform("i", lambda x: x["source_id"])
    return kinds.join(texts, "entity_name").join(ids, "entity_name").select(
        "entity_name", "entity_type", F.array_join(F.transform("d", lambda x: x["description"]), separator).alias("description"), (F.slice(source_ids, 1, id_cap) if id_cap else source_ids).alias("source_ids"), "mentions", F.lit(0).alias("degree"),
    )


def concat_entities(rows: DataFrame, order: list[str], separator: str = "|Here is another description : ") -> DataFrame:
    """The build's merge: every description is kept, repeats too."""
    seen = F.array_sort(F.collect_list(F.struct(*order, "description", "source_id")))
    grouped = rows.groupBy("entity_name").agg(seen.alias("s"))
    return grouped.select("entity_name", F.array_join(F.transform("s", lambda x: x["description"]), separator).alias("description"), F.array_distinct(F.transform("s", lambda x: x["source_id"])).alias("source_ids"), F.lit(0).alias("degree"))


def upsert_relations(rows: DataFrame, order: Column | str, values: list[str], keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """The last row of each key, at the place (``first_ord``) of the first."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_ord"), *[F.max_by(v, order).alias(v) for v in values])


def first_in_chunk_last_over_all(rows: DataFrame, key: str = "entity_name", value: str = "description") -> DataFrame:
    """Of each chunk the first mention, of these the last chunk's."""
    inside = rows.groupBy(key, "chunk_ord").agg(F.min_by(value, "pos").alias(value))
    return inside.groupBy(key).agg(F.max_by(value, "chunk_ord").alias(value))


def summarize_long(rows: DataFrame, model, max_tokens: int = 50, col: str = "description") -> DataFrame:
    """Descriptions over ``max_tokens`` words go to the model; where it is silent the text stays."""
    return rows.withColumn(col, F.coalesce(ask(model, F.when(T.token_count(col) > max_tokens, F.col(col))), F.col(col)))


def combine_relations(base: DataFrame, generated: DataFrame, values: list[str]) -> DataFrame:
    """Base and generated relations in one; a generated one stands for a base one of the same key."""
    both = base.withColumn("__o", F.lit(0)).unionByName(generated.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return upsert_relations(both, "__o", values).drop("first_ord")


def first_by_name(rows: DataFrame, order: str, name: str = "entity_name") -> DataFrame:
    """The first row of each name."""
    w = Window.partitionBy(name).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def real_degree(relations: DataFrame) -> DataFrame:
    """Number of distinct neighbours of each name."""
    ends = relations.select(F.col("src").alias("entity_name"), F.col("dst").alias("other")).unionByName(relations.select(F.col("dst").alias("entity_name"), F.col("src").alias("other")))
    return ends.groupBy("entity_name").agg(F.count_distinct("other").alias("degree"))


def chunk_map(rows: DataFrame, order: str) -> DataFrame:
    """Text of each hash; the last one wins."""
    return rows.groupBy("hash_code").agg(F.max_by("text", order).alias("text"))
