"""Build, answer and predict end to end, against what a small corpus must give."""

import numpy as np
import pytest

from grovekit import engine, models
from grovekit.config import Settings
from grovekit.functions import text as T
from grovekit.operators import extraction, hierarchy
from grovekit.sources import readers
from grovekit.sources.checkpoints import cut
from pyspark.sql import functions as F


def echo(prompt, system_prompt=None, history=None):
    """The last source text of a prompt's context."""
    return prompt.split("text_units:\nid\t\ttext\n")[-1].split("\nQuestion:")[0].split("\n")[0]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"h{i}", f"Red Engine{i} runs on Blue Steam. It is said that Engine{i} stops at Port{i % 5}.", i) for i in range(12)]
    return spark.createDataFrame(rows, "hash_code string, text string, ord int")


def test_build_answer_predict(spark, chunks, tmp_path):
    nodes, relations, reports = engine.build_graph(chunks, str(tmp_path / "w"), settings=Settings(cluster_size=4))
    cited = {r.entity_name: r.source_ids for r in nodes.filter("level = 0").collect()}
    assert "Blue Steam" in cited and len(cited["Blue Steam"]) == 5  # of twelve chunks the store keeps five
    assert hierarchy.orphans(nodes).count() == 0 and nodes.filter("parent = 'root'").count() == 1
    assert relations.filter("level = 0").count() > 20
    asked = spark.createDataFrame([("d", "1", "Blue Steam", "text"), ("d", "2", "Port3", "x")], "doc_id string, question_id string, question string, answer string")
    got = engine.answer(asked.withColumn("qid", F.col("question_id")), nodes, relations, reports, chunks, echo, settings=Settings(top_k=3)).collect()
    assert len(got) == 2
    for r in got:
        assert [p for p in ("entity_information", "aggregation_entity_information", "reasoning_path_information", "text_units") if p + ":\n" in r.context]
        assert r.context.index("entity_information") < r.context.index("text_units") and "Engine" in r.answer
    asked = asked.withColumn("metadata", F.create_map().cast("map<string,string>"))
    said = engine.predict(asked, str(tmp_path / "w"), echo)
    assert {(r.question_id, r.trace_error) for r in said.collect()} == {("1", None), ("2", None)}
    assert engine.score(asked, said).first()["count"] == 2
    assert {r.trace_error for r in engine.predict(asked, str(tmp_path / "w"), models.silent_model).collect()} == {"no answer"}


def test_document_stands_for_no_entities(spark, chunks):
    blank = spark.createDataFrame([("h", "...", 0)], "hash_code string, text string, ord int")
    entities, relations = engine.extract_graph(blank)
    assert [(r.entity_name, r.source_ids) for r in entities.collect()] == [("document", ["h"])] and relations.count() == 0


def test_clusters_of_many_cells(spark):
    """Well-parted groups stay together, equal vectors are parted by hash, and every row has one cluster."""
    rng = np.random.default_rng(3)
    rows = [(f"n{i}", [float(x) for x in rng.normal([(i % 3) * 50, 1, (i % 2) * 30, 9], 0.01)]) for i in range(600)] + [(f"e{i}", [1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    df = cut(spark.createDataFrame(rows, "entity_name string, embedding array<float>"))
    got = hierarchy.cluster_layer(df, 20, cell_rows=60).toPandas()
    assert sorted(got.entity_name) == sorted(r[0] for r in rows)
    sizes = got.groupby("cluster").size()
    assert len(sizes) > 10 and sizes.max() < 300
    again = hierarchy.cluster_layer(df.repartition(3), 20, cell_rows=60).toPandas()
    assert dict(zip(got.entity_name, got.cluster)) == dict(zip(again.entity_name, again.cluster))


def test_axes_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [9, 3, 1, 1, 1] + [2, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, embedding array<double>").repartition(4)
    mean, axes = hierarchy.principal_axes(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, _, v = np.linalg.svd(unit - unit.mean(0), full_matrices=False)
    assert np.allclose(mean, unit.mean(0)) and np.allclose(np.abs((axes * v[:2].T).sum(0)), 1)


def test_model_helpers(spark, tmp_path):
    chat = models.HttpChat("http://localhost/v1/", "m", most_chars=5)
    assert chat.request("0123456789", "s", [{"role": "user", "content": "a"}]) == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "a"}, {"role": "user", "content": "01234"}]}
    assert models.Limited(lambda p: p + "!", 1)("a") == "a!"
    rows = spark.createDataFrame([("a",), (None,), ("boom",)], "p string")
    assert [r[0] for r in rows.select(models.ask(lambda p: {"a": "said"}[p], F.col("p"))).collect()] == ["said", None, None]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "qa.jsonl").write_text('{"question": "q", "answer": "a"}\n')
    (tmp_path / "deep" / "predictions.jsonl").write_text('{"question": "q2", "answer": "a"}\n')
    (tmp_path / "other.jsonl").write_text('{"name": "n"}\n')
    assert [r.question for r in readers.find_qa(spark, str(tmp_path)).collect()] == ["q"]
    assert readers.count_lines(spark, str(tmp_path / "other.jsonl")) == 1
    maps = spark.sql("select map('a', 1.0d, 'b', 2.0d) x, map('b', 2.0000001d, 'a', 1.0d) y, map('a', 1.0d) z, map('a', 1.0d, 'c', 2.0d) w")
    assert maps.select(T.almost_equal("x", "y"), T.almost_equal("x", "z"), T.almost_equal("x", "w")).first() == (True, False, False)


def test_chunk_text_joins_left(spark):
    triples = spark.createDataFrame([("h1", "a"), ("h9", "b")], "source_id string, head string")
    chunks = spark.createDataFrame([("h1", "text")], "hash_code string, text string")
    assert sorted((r.source_id, r.text) for r in extraction.with_chunk_text(triples, chunks).collect()) == [("h1", "text"), ("h9", "")]
