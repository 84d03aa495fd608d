"""A corpus pipeline: language, near copies, repeated strings, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of their input in its order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm import decontamination, jaccard_join, language_id, packing, suffix_dedup
from grovekit.llm.common import cut, ensure_checkpoint_dir, prepare, read_table

BROADCAST_IDS = 1_000_000
NEAR_WORDS, NEAR_PERCENT = 5, 80  # near copies of a corpus; op9 has its own
SURE = 0.5  # least score of a language that is told


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told stay, and a null ``lang`` becomes the language told.

    Texts without a letter, null and empty texts, and texts for which no language
    has ``SURE`` of the score go; only texts without a letter where no row has a
    language to learn from. Repeated rows are treated alike; an empty table stays empty.
    """
    prepare(spark)
    model = language_id.fit(docs)
    if not model.langs:
        return docs.filter(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    plain = docs.select("doc_id", "text", *[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)])
    told = language_id.predict(plain, model, "doc_id", "text", *plain.columns[2:]).filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE))
    named = [F.coalesce(f"__{i}", "lang_pred") if c == "lang" else F.col(f"__{i}") for i, c in enumerate(docs.columns)]
    return told.select(*[x.alias(c) for x, c in zip(named, docs.columns, strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays.

    Rows go by their id: rows that repeat an id stay or go together. Null ids,
    and texts without words, which are near to nothing, stay.
    """
    prepare(spark)
    joined = jaccard_join.join_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = cut(joined.filter("doc_id <> component_id").select("doc_id").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are taken out.

    Null texts stay, and so do rows of one id beside each other; rows of which
    white space alone is left by that go. Long texts are treated whole.
    """
    prepare(spark)
    return _counted(suffix_dedup.remove_repeats(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items go; a single item's words are taken out. Null and empty texts, and all where there is no item, stay as they are."""
    return _counted(decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 4096 tokens; null and empty texts as their end id alone, repeated rows each."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language scores and tokenising aren't SQL; tests/llm/test_pipeline.py compares run() with plain versions of all stages.
ORACLE_SQL = None


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again; the table of a stage goes when the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            _forget(spark, f"{folder}/{last}")
        docs, last = spark.read.parquet(f"{folder}/{name}"), name
    return docs
