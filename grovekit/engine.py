"""End to end: chunks to a workspace, questions to answers, question files to scored predictions.

Models are callables (``grovekit.models``); the defaults need none, so that a
build or an answer without a model is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.config import Settings
from grovekit.models import PROMPTS, Embedder, HashEmbedder, TextModel, ask, embed, silent_model
from grovekit.operators import evaluation, extraction, hierarchy, merging, retrieval
from grovekit.sources import writers
from grovekit.sources.checkpoints import cut


def extract_graph(chunks: DataFrame, model: TextModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of chunks ``hash_code, text, ord``: by the model's records, else by capitalised phrases and their neighbourhood."""
    if model is None:
        entities = extraction.document_entity(extraction.heuristic_entities(chunks), chunks)
        found = extraction.cooccurrences(chunks).join(chunks.select(F.col("hash_code").alias("source_id"), "ord"), "source_id")
        order = F.struct("ord", "pos")
        return entities, merging.upsert_relations(found, order, ["description", "source_id"]).drop("first_ord").withColumn("weight", F.lit(1))
    head, tail = PROMPTS["extract"].split("{text}")
    said = cut(chunks.select(F.col("hash_code").alias("source_id"), ask(model, F.concat(F.lit(head), "text", F.lit(tail))).alias("answer")))
    entities, relations = extraction.records(said)
    return merging.merge_entities(entities, ["source_id", "ord"]).drop("mentions"), merging.upsert_relations(relations, F.struct("source_id", "ord"), ["description", "weight", "source_id"]).drop("first_ord")


def build_graph(chunks: DataFrame, path: str, model: TextModel | None = None, embedder: Embedder | None = None, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks to merged entities, their tree, lifted relations and reports, written to ``path``; returns the stored tables.

    Long descriptions are summarised by the model before they are embedded.
    """
    settings = settings or Settings()
    spark = chunks.sparkSession
    entities, relations = (cut(t) for t in extract_graph(chunks, model))
    if model is not None:
        entities = cut(merging.summarize_long(entities, model, settings.summary_tokens))
    degrees = merging.real_degree(relations)
    named = entities.drop("degree").join(degrees, "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    flat = named.select("entity_name", "entity_type", "description", F.array_join("source_ids", "|").alias("source_id"), "degree")
    vectors = lambda df: embed(df, embedder or HashEmbedder())
    nodes, lifted, reports = hierarchy.build_tree(flat, relations, vectors, model or silent_model, settings.cluster_size, cut=cut)
    base = relations.select("src", "dst", "description", F.col("weight").cast("int").alias("weight"), F.lit(0).alias("level"))
    relations = base if lifted is None else base.unionByName(lifted.withColumn("weight", F.col("weight").cast("int")))
    if reports is None:
        reports = nodes.limit(0).select("entity_name", F.col("description").alias("entity_description"), "level")
    stored = vectors(nodes).withColumn("source_ids", F.split("source_id", r"\|")).drop("source_id")
    writers.save_workspace(path, stored, relations, reports, settings.evidence_k)
    writers.save_chunks(path, chunks)
    return writers.load_workspace(spark, path)


def contexts(questions: DataFrame, nodes: DataFrame, relations: DataFrame, communities: DataFrame, chunks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``qid, context`` of every question ``qid, q``: entities, reports, path relations and source texts, each as a table.

    Entities come by rank, reports and relations by name, texts by votes; parts
    of which nothing was found hold their heading alone.
    """
    s = settings or Settings()
    base = retrieval.by_level(nodes, s.level_mode)
    top = cut(retrieval.vector_top_k_batch(base, questions, s.top_k, "entity_name").select("qid", F.col("rank").alias("pos"), F.col("entity_name").alias("anchor")))
    paths = cut(retrieval.anchor_paths(top, nodes.select(F.col("entity_name").alias("name"), "parent", "level"), int(nodes.agg(F.max("level")).first()[0] or 0) + 1, s.lca_mode))
    told = base.select(F.col("entity_name").alias("anchor"), "description", "source_ids")
    found = top.join(told, "anchor")
    voted = retrieval.evidence_texts(retrieval.vote_evidence(found.select("qid", F.col("pos").alias("ord"), "source_ids"), s.evidence_k, ["qid"]), chunks)
    parts = [
        ("entity_information", retrieval.render_table(found, ["anchor", "description"], ["qid"], ["pos"], "p0"), "entity_name\t\tdescription"),
        ("aggregation_entity_information", retrieval.render_table(retrieval.communities_of(paths, communities), ["entity_name", "entity_description"], ["qid"], ["entity_name"], "p1"), "entity_name\t\tentity_description"),
        ("reasoning_path_information", retrieval.render_table(retrieval.path_links(paths, relations.withColumn("ord", F.col("level"))), ["description"], ["qid"], ["description"], "p2"), "description"),
        ("text_units", retrieval.render_table(voted, ["rank", "text"], ["qid"], ["rank"], "p3"), "id\t\ttext"),
    ]
    out = questions.select("qid")
    for _, table, _ in parts:
        out = out.join(table, "qid", "left")
    text = [F.concat(F.lit(f"{name}:\n{head}\n"), F.coalesce(f"p{i}", F.lit(""))) for i, (name, _, head) in enumerate(parts)]
    return out.select("qid", F.concat_ws("\n", *text).alias("context"))


def answer(questions: DataFrame, nodes: DataFrame, relations: DataFrame, communities: DataFrame, chunks: DataFrame, model: TextModel, embedder: Embedder | None = None, settings: Settings | None = None) -> DataFrame:
    """``qid, question, context, answer`` of every question ``qid, question``; an answer is null where the model is silent."""
    asked = cut(embed(questions.select("qid", "question"), embedder or HashEmbedder(), "question", "q"))
    found = questions.select("qid", "question").join(contexts(asked.select("qid", "q"), nodes, relations, communities, chunks, settings), "qid")
    head, middle = PROMPTS["answer"].split("{context}")
    middle, tail = middle.split("{question}")
    return found.withColumn("answer", ask(model, F.concat(F.lit(head), "context", F.lit(middle), "question", F.lit(tail))))


def predict(questions: DataFrame, path: str, model: TextModel, embedder: Embedder | None = None, settings: Settings | None = None) -> DataFrame:
    """Predictions of a question table (``grovekit.schema.QA``) from a stored workspace, in the form that ``evaluation.score_rows`` takes."""
    spark = questions.sparkSession
    keyed = questions.withColumn("qid", F.concat_ws("#", "doc_id", "question_id"))
    said = answer(keyed, *writers.load_workspace(spark, path), writers.load_chunks(spark, path), model, embedder, settings)
    pages = F.array().cast("array<struct<page: int, page_start: int, page_end: int>>")
    said = said.select("qid", F.col("answer").alias("said"))
    return keyed.join(said, "qid", "left").select(
        "doc_id", "question_id", "question", F.col("answer").alias("gold_answer"), F.coalesce("said", F.lit("")).alias("prediction"),
        pages.alias("text_evidence"), pages.alias("visual_evidence"), pages.alias("table_evidence"), F.when(F.col("said").isNull(), "no answer").alias("trace_error"),
    )


def score(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Means of all metrics over predictions and their gold rows."""
    return evaluation.means(evaluation.score_rows(predictions, questions))
