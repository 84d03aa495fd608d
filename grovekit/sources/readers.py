"""Readers: every format becomes a DataFrame with a given schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import text as T

QUESTION_KEYS = ("question", "query", "input")
ANSWER_KEYS = ("answer", "answers", "gold_answer", "ground_truth")
DOCUMENT_KEYS = ("doc_id", "document_id", "doc", "pdf", "file", "filename")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines and a byte order mark are skipped, broken lines are null rows (permissive)."""
    reader = spark.read.option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document: an array's elements or one object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, value`` of top-level fields; nested values as JSON."""
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for p in parts:
            rows = [(f, str(k), v if isinstance(v, str) else json.dumps(v, default=str)) for f, t in zip(p["path"], p["value"], strict=True) for k, v in (yaml.safe_load(t) or {}).items()]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return read_whole(spark, path).mapInPandas(parse, "path string, key string, value string")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook; needs the optional openpyxl. One file is one small table."""
    try:
        return spark.createDataFrame(pd.read_excel(path))
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "txt": read_lines, "md": read_whole, "csv": read_csv, "json": read_json, "jsonl": read_jsonl, "yaml": read_yaml, "yml": read_yaml, "xlsx": read_excel,
    "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path),
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read by the path's extension."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    if ext not in FORMATS:
        raise ValueError(f"no reader for .{ext}")
    return FORMATS[ext](spark, path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Records of json, jsonl or parquet only."""
    if path.rstrip("/").rpartition(".")[2].lower() not in ("json", "jsonl", "parquet"):
        raise ValueError(f"not a metadata format: {path}")
    return read_any(spark, path)


def alias_columns(df: DataFrame, **names: tuple[str, ...]) -> DataFrame:
    """Each name as the first of its candidate columns that is there, neither null nor empty."""
    have = set(df.columns)
    cols = {out: [c for c in candidates if c in have] for out, candidates in names.items()}
    return df.select(*[(T.first_value(*c) if c else F.lit(None).cast("string")).alias(out) for out, c in cols.items()])


def has_qa_shape(df: DataFrame) -> bool:
    have = {c.lower() for c in df.columns}
    return bool(have & set(QUESTION_KEYS)) and bool(have & set(ANSWER_KEYS))


def find_qa(spark: SparkSession, folder: str, own: tuple[str, ...] = ("predictions", "manifest", "scores")) -> DataFrame | None:
    """Questions of all files of a folder and its subfolders; files whose path names one of our ``own`` artifacts are left out. Only names are listed."""
    kinds = ("jsonl", "json", "csv", "parquet")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(folder).select("path")
    paths = sorted(r.path for r in files.collect())
    return read_qa(spark, *(p for p in paths if not any(w in p.rpartition("/")[2].lower() for w in own)))


def read_qa(spark: SparkSession, *paths: str) -> DataFrame:
    """Questions of several files in one table; other columns go to ``metadata``. Files without the shape of questions are skipped."""
    out = None
    for p in paths:
        df = read_any(spark, p)
        if not has_qa_shape(df):
            continue
        used = set(QUESTION_KEYS) | set(ANSWER_KEYS) | set(DOCUMENT_KEYS) | {"question_id", "pdf_path"}
        free = [c for c in df.columns if c not in used]
        meta = F.map_from_arrays(F.array(*[F.lit(c) for c in free]), F.array(*[F.col(c).cast("string") if not df.schema[c].dataType.simpleString().startswith(("array", "struct")) else F.to_json(c) for c in free])) if free else F.create_map().cast("map<string,string>")
        question_id = T.first_value("question_id") if "question_id" in df.columns else T.content_id(*[c for c in QUESTION_KEYS if c in df.columns])
        rows = df.withColumns({"__m": meta, "__q": question_id})
        cand = {"doc_id": DOCUMENT_KEYS, "pdf_path": ("pdf_path",), "question": QUESTION_KEYS, "answer": ANSWER_KEYS}
        have = set(df.columns)
        picked = [(T.first_value(*[c for c in cs if c in have]) if have & set(cs) else F.lit(None).cast("string")).alias(n) for n, cs in cand.items()]
        rows = rows.select(*picked, F.col("__q").alias("question_id"), F.col("__m").alias("metadata"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "doc_id string, pdf_path string, question string, answer string, question_id string, metadata map<string,string>")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stripped lines."""
    return spark.read.text(path).select(T.strip("value").alias("word")).filter("word <> ''").distinct()


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-parted triples in brackets."""
    return spark.read.text(path).select(T.triple_parts("value").alias("p")).filter("size(p) >= 3").select(F.get("p", F.lit(0)).alias("head"), F.get("p", F.lit(1)).alias("relation"), F.get("p", F.lit(2)).alias("tail"))


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page, text`` of binary documents; ``parse`` gives the pages of one file and is the caller's."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(f, i + 1, t) for f, c in zip(p["path"], p["content"], strict=True) for i, t in enumerate(parse(c))], columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def first_artifact(spark: SparkSession, folder: str, glob: str) -> str | None:
    """The first path, in order of name, that fits a glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.agg(F.min("path")).first()[0]
