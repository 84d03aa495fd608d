"""Named queries over workspaces, evidence and models, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit import models
from grovekit.functions import text as T
from grovekit.operators import chunking, evaluation, extraction, hierarchy, media, merging, retrieval
from grovekit.plans.catalog import MENT, QUERIES, _mentions, _tree, query, table


def _named(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# Models that answer without a model, for the queries below.


def list_keeper(prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> str:
    """The lines of a prompt's list that don't start with T, twice."""
    kept = [x for x in prompt.split("\n")[1:] if not x.startswith("T")]
    return "\n".join(kept + kept)


def length_teller(prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> str:
    return f"{len(prompt)} characters"


# --- evidence ---------------------------------------------------------------------------------------------------


@query("SELECT l.doc_id AS source_id, md5(coalesce(text, '')) AS text_md5 FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def chunk_text_join(spark, d):
    chunks = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("hash_code"), "text")
    triples = table(spark, d, "labels").select(F.col("doc_id").alias("source_id"))
    return extraction.with_chunk_text(triples, chunks).select("source_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT l.doc_id::VARCHAR AS source_id, md5(text) AS text_md5 FROM (SELECT doc_id * 2 AS doc_id FROM labels) l JOIN documents USING (doc_id)")
def evidence_texts(spark, d):
    voted = table(spark, d, "labels").select((F.col("doc_id") * 2).cast("string").alias("source_id"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("hash_code"), "text")
    return retrieval.evidence_texts(voted, chunks).select("source_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT media_id, count(*) AS score FROM (SELECT 'm' || (doc_id % 10)::VARCHAR AS media_id FROM documents UNION ALL SELECT 'm' || (doc_id % 31)::VARCHAR FROM documents) JOIN (SELECT 'm' || n_nationkey::VARCHAR AS media_id FROM nation) USING (media_id) GROUP BY media_id")
def media_votes(spark, d):
    """Even documents are found by their chunk's hash, odd ones by its id; media of unknown ids are left out."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    evidence = docs.select(_named("h", "doc_id").alias("hash_code"), _named("c", "doc_id").alias("chunk_id"), k.alias("ord"))
    attached = F.array(F.concat(F.lit("m"), (k % 10).cast("string")), F.concat(F.lit("m"), (k % 31).cast("string")))
    chunks = docs.select(F.when(k % 2 == 0, _named("h", "doc_id")).otherwise(F.lit("other")).alias("hash_code"), F.when(k % 2 == 1, _named("c", "doc_id")).otherwise(F.lit("none")).alias("chunk_id"), attached.alias("attached_media_ids"))
    return retrieval.media_votes(evidence, chunks, table(spark, d, "nation").select(_named("m", "n_nationkey").alias("media_id"))).select("media_id", "score")


@query("SELECT DISTINCT c_custkey AS qid, 'r' || r_regionkey::VARCHAR AS entity_name, r_name AS entity_description FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def community_reports(spark, d):
    leaves, parents = _tree(spark, d, "customer", "c_custkey", "c_nationkey")
    paths = retrieval.chains(leaves, parents, 3).join(leaves, "anchor").select(F.col("k").alias("qid"), F.col("chain").alias("path"))
    reports = table(spark, d, "region").select(_named("r", "r_regionkey").alias("entity_name"), F.col("r_name").alias("entity_description"))
    return retrieval.communities_of(paths, reports.unionByName(reports))


@query("SELECT DISTINCT s_suppkey AS qid, 'in ' || r_name AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_links(spark, d):
    """Relations point both ways in turn; the forward one of a path's pair is taken."""
    leaves, parents = _tree(spark, d, "supplier", "s_suppkey", "s_nationkey")
    paths = retrieval.chains(leaves, parents, 2).join(leaves, "anchor").select(F.col("k").alias("qid"), F.col("chain").alias("path"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name, other = _named("n", "n_nationkey"), _named("r", "n_regionkey")
    up = n.select(name.alias("src"), other.alias("dst"), F.concat(F.lit("in "), "r_name").alias("description"), F.lit(1).alias("ord"))
    down = n.filter("n_nationkey % 2 = 0").select(other.alias("src"), name.alias("dst"), F.lit("holds").alias("description"), F.lit(0).alias("ord"))
    return retrieval.path_links(paths, up.unionByName(down))


@query("SELECT 'n' || n_nationkey::VARCHAR AS entity_name, n_name AS description FROM nation WHERE n_nationkey % 2 = 0")
def node_rows(spark, d):
    n = table(spark, d, "nation")
    names = n.select(_named("n", "n_nationkey").alias("entity_name")).unionByName(spark.range(1).select(F.lit("root").alias("entity_name")))
    nodes = n.select(_named("n", "n_nationkey").alias("entity_name"), F.col("n_name").alias("description"), (F.col("n_nationkey") % 2).alias("level"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit("root").alias("entity_name"), F.lit("all").alias("description"), F.lit(0).cast("int").alias("level")).select(*[F.col(c).cast(nodes.schema[c].dataType) for c in nodes.columns]))
    return retrieval.node_rows(names, nodes).select("entity_name", "description")


# --- triples and entities ---------------------------------------------------------------------------------------


@query("SELECT doc_id AS ord, lang || ' x' AS entity_name FROM (SELECT *, lag(lang) OVER (ORDER BY doc_id) AS before FROM documents) WHERE before IS NULL OR before <> lang")
def triple_entities(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("<"), "lang", F.lit("__x>")).alias("head"))
    return extraction.entities_of_triples(rows)


@query("""SELECT n_nationkey, n_name AS head, CASE WHEN n_nationkey % 4 <> 0 THEN 'one of ' || r_name END AS head_desc, 'part of' AS relation, CASE WHEN n_nationkey % 4 <> 0 THEN 'lies in' END AS relation_desc, r_name AS tail, NULL::VARCHAR AS tail_desc
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def described_triples(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.concat(F.lit(' {"subject": {"description": "one of '), "r_name", F.lit('", "type": "nation"}, "relation": {"description": "lies in"}, "object": null} '))
    rows = n.select("n_nationkey", F.concat(F.lit("<"), "n_name", F.lit(">\t<part of>\t<"), "r_name", F.lit(">")).alias("triple"), F.when(F.col("n_nationkey") % 4 != 0, said).otherwise("no answer").alias("answer"))
    return extraction.described_triples(rows).select("n_nationkey", "head", "head_desc", "relation", "relation_desc", "tail", "tail_desc")


@query("SELECT count_if(l_linenumber % 2 = 0)::BIGINT AS with_description, count_if(l_linenumber % 2 = 1)::BIGINT AS without FROM lineitem")
def packed_widths(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.lit("a\tb\tc\td\te\tf")).otherwise(F.lit("a\tb\tc")).alias("triple"))
    return evaluation.packed_widths(rows)


@query(f"WITH {MENT} SELECT DISTINCT trim(entity_name) AS entity_name FROM ment WHERE NOT starts_with(entity_name, 'T') AND trim(entity_name) <> ''")
def verified_entities(spark, d):
    return models.verify_entities(_mentions(spark, d), list_keeper)


@query(r"SELECT doc_id, md5(CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 50 THEN length(text)::VARCHAR || ' characters' ELSE text END) AS described FROM documents")
def summarized_descriptions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return merging.summarize_long(rows, length_teller).select("doc_id", F.md5(F.col("description").cast("binary")).alias("described"))


# --- trees and workspaces ---------------------------------------------------------------------------------------


@query("SELECT n_name AS entity_name, 'root' AS parent, 0 AS level, (SELECT count(*) FROM nation)::VARCHAR || ' entities' AS report FROM nation")
def flat_tree(spark, d):
    entities = table(spark, d, "nation").select(F.col("n_name").alias("entity_name"))
    nodes, _, report = hierarchy.flat_tree(entities, entities.select(F.col("entity_name").alias("src"), F.col("entity_name").alias("dst")))
    return nodes.join(report.select(F.col("entity_name").alias("parent"), F.col("entity_description").alias("report")), "parent").select("entity_name", "parent", "level", "report")


@query("SELECT count(*) AS base_nodes, 0::BIGINT AS orphans, 1::BIGINT AS roots, 0::BIGINT AS twice FROM embeddings")
def tree_invariants(spark, d):
    """What must hold of the tree that ``hierarchy_build`` gives: all vectors at the base, every parent one level up, one root, one parent each."""
    from grovekit.sources.checkpoints import cut

    nodes = cut(QUERIES["hierarchy_build"](spark, d))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    base = count(nodes.filter("level = 0"), "base_nodes")
    lost = count(hierarchy.orphans(nodes), "orphans")
    roots = count(nodes.filter("parent = 'root'"), "roots")
    twice = count(nodes.groupBy("entity_name", "level").count().filter("count > 1"), "twice")
    return base.join(lost, F.lit(True)).join(roots, F.lit(True)).join(twice, F.lit(True))


# --- evaluation -------------------------------------------------------------------------------------------------


@query("SELECT role, count(*) AS calls, coalesce(sum(CASE WHEN turn % 3 <> 0 THEN length(text) END), 0)::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens FROM conversations GROUP BY role")
def token_totals(spark, d):
    calls = table(spark, d, "conversations").select("role", F.when(F.col("turn") % 3 != 0, F.length("text")).alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    return evaluation.token_totals(calls, "role")


@query("SELECT p.conv_id AS doc_id, p.turn, g.text AS answer FROM conversations p LEFT JOIN conversations g ON p.conv_id = g.conv_id AND p.turn = g.turn AND g.role = 'user'")
def gold_match_by_text(spark, d):
    """Odd turns have another question id, and are matched by their question's text."""
    c = table(spark, d, "conversations")
    ask = F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question")
    gold = c.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("question_id"), ask, F.col("text").alias("answer"))
    pred = c.select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") % 2 == 1, F.col("turn") + 1000).otherwise(F.col("turn")).alias("question_id"), ask)
    return evaluation.match_gold(pred, gold).select("doc_id", "turn", F.col("gold.answer").alias("answer"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN (l_suppkey % 2 = 0)::INT::DOUBLE WHEN l_linenumber % 4 = 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 0.8 END ELSE (l_suppkey % 2 = 0)::INT::DOUBLE END AS answer_score FROM lineitem""")
def answer_formats(spark, d):
    """Whole numbers, numbers with a fraction, lists of which one item may be missing, and questions without an answer."""
    right, n = F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") % 4
    kind = F.when(n == 0, "Int").when(n == 1, "Float").when(n == 2, "List").otherwise("None")
    gold = F.when(n == 0, F.lit("120")).when(n == 1, F.lit("3.25")).when(n == 2, F.lit("['red box', 'blue cup', 'old hat']")).otherwise(F.lit("Not answerable"))
    said = F.when(n == 0, F.when(right, "about 120 of them").otherwise("121")).when(n == 1, F.when(right, "325% in all").otherwise("3.5")).when(n == 2, F.when(right, "old hat, the red box and a blue cup").otherwise("blue cup; red box")).otherwise(F.when(right, "Not answerable").otherwise("red"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *T.answer_scores(gold, said, kind))
    return rows.select("l_orderkey", "l_linenumber", F.round("answer_score", 6).alias("answer_score"))


@query("SELECT event_id, value IS NOT NULL AS known, abs(value - round(value, 2)) <= 0.001 AS same FROM events")
def nearly_equal(spark, d):
    e = table(spark, d, "events").withColumn("value", T.nan_to_null("value"))
    a, b = F.create_map(F.lit("v"), "value"), F.create_map(F.lit("v"), F.round("value", 2))
    return e.select("event_id", F.col("value").isNotNull().alias("known"), T.almost_equal(a, b, 0.001).alias("same"))


@query(r"SELECT doc_id, (i // 224)::INT AS chunk_index, md5(substring(text, i::INT + 1, 256)) AS hash_code FROM (SELECT doc_id, text, unnest(range(0, length(text), 224)) AS i FROM documents)")
def chunk_token_windows(spark, d):
    """Windows by a tokenizer of the caller's: here every character is a token."""
    rows = chunking.word_windows(table(spark, d, "documents"), 256, 32, tokenizer=lambda t: F.split(t, "(?s)(?<=.)(?=.)"), joiner="")
    return rows.select("doc_id", "chunk_index", "hash_code")


@query("""WITH p AS (SELECT DISTINCT p_name AS n FROM part), f AS (SELECT DISTINCT upper(split_part(n, ' ', 2)) AS file_name FROM p UNION SELECT n FROM p WHERE starts_with(n, 's'))
SELECT n AS doc_name, coalesce(max(CASE WHEN file_name = n THEN n END), min(file_name)) AS file_name FROM p JOIN f ON contains(lower(n), lower(file_name)) OR contains(lower(file_name), lower(n)) GROUP BY n""")
def file_match(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("doc_name")).distinct()
    last = names.select(F.upper(F.split_part("doc_name", F.lit(" "), F.lit(2))).alias("file_name"))
    return media.match_files(names, last.unionByName(names.filter("doc_name like 's%'").select(F.col("doc_name").alias("file_name"))).distinct())
