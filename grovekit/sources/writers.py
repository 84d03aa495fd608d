"""Writers: a build is a full refresh, so sinks overwrite."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.operators.hierarchy import store_relations


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by the path's extension; the target is a folder of part files."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    w = df.write.mode(mode)
    if ext in ("json", "jsonl"):
        w.json(path)
    elif ext == "csv":
        w.option("header", True).csv(path)
    elif ext in ("txt", "md"):
        w.text(path)
    elif ext in ("parquet", "orc"):
        w.format(ext).save(path)
    else:
        raise ValueError(f"no writer for .{ext}")


def workspace_name(path: str) -> str:
    """A table prefix for a workspace, from its folder's name."""
    base = path.rstrip("/").rpartition("/")[2]
    return "grove_" + hashlib.md5(base.encode()).hexdigest()[:16]


def save_workspace(path: str, entities: DataFrame, relations: DataFrame, communities: DataFrame, id_cap: int = 5) -> None:
    """The three tables of a build. Entities are parted by level, so that a level filter prunes files."""
    entities.withColumn("source_ids", F.slice("source_ids", 1, id_cap)).write.mode("overwrite").partitionBy("level").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    communities.write.mode("overwrite").parquet(f"{path}/communities")


def save_base_relations(path: str, relations: DataFrame) -> None:
    store_relations(relations).write.mode("overwrite").parquet(f"{path}/base_relations")


def load_workspace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("entities", "relations", "communities"))


def save_chunks(path: str, chunks: DataFrame) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def save_evidence(path: str, chunks: DataFrame, media: DataFrame) -> None:
    """Chunks, media and the text-only export."""
    save_chunks(path, chunks)
    media.write.mode("overwrite").parquet(f"{path}/media")
    chunks.filter("modality = 'text'").select("hash_code", "text").write.mode("overwrite").parquet(f"{path}/text_chunks")


def record_manifest(path: str, rows: DataFrame) -> None:
    """Add to the manifest; readers take the last row of a document."""
    rows.withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.groupBy("doc_id").agg(*[F.max_by(c, "written").alias(c) for c in rows.columns if c not in ("doc_id", "written")])


def sorted_lines(lines: DataFrame, distinct: bool = True, col: str = "value") -> DataFrame:
    """Lines in order, each once; sorting and folding spill by themselves."""
    return (lines.select(col).distinct() if distinct else lines.select(col)).orderBy(col)


def split_parts(df: DataFrame, path: str, n: int) -> None:
    """About equal parts as ``n`` files."""
    df.repartition(n).write.mode("overwrite").json(path)
