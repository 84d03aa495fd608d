"""Registered queries against SQL, and the pipeline's stages on the small tables."""

import glob
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from grovekit.llm import language_id, registry, suffix_dedup
from tests.llm.test_ops import plain_components, plain_words


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == sorted((tuple(v for _, v in sorted(zip(columns, r, strict=True))) for r in cur.fetchall()), key=repr)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = docs.withColumn("score", docs.n_chars * 1.0).withColumn("lang_pred", docs.lang)
    before, sizes = clash, [clash.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert after.columns == clash.columns
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
            assert after.filter("n_chars <> length(text)").count() == 0
            sizes.append(after.count())
            before = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0] - 40
    assert after.select("doc_id").distinct().count() == before.count()
    assert {r[0] for r in after.groupBy("sequence_id").sum("length").select("sum(length)").collect()} <= {1 << k for k in range(13)}


def plain_repeats_gone(rows, length=50):
    """Rows without the strings that a document with a smaller id has, and without rows of which only white space is left."""
    rank = lambda i: suffix_dedup.LAST if i is None else i
    starts, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            starts[b[s : s + length]] = min(starts.get(b[s : s + length], suffix_dedup.LAST), rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] < rank(i):
                gone[s : s + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        if not any(gone):
            out.append((i, t))
        elif left.strip():
            out.append((i, left.decode(errors="ignore")))
    return out


def plain_leaks_gone(rows, items, n=8):
    windows = {}
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - n + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if own := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    found |= own
        if len(found) == 1:
            parts = re.split(r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", t)
            lead = parts.pop(0) if not plain_words(parts[0]) else ""
            t = lead + "".join(x for j, x in enumerate(parts) if j not in hit)
        if len(found) < 2:
            out.append((i, t))
    return out


def test_run_as_plain_versions(spark, tmp_path):
    """All stages against plain versions over nulls, empty and long texts, copies, near copies, shared passages and leaks."""
    rng = random.Random(21)
    tongue = {"en": [f"the{c}th" for c in "abcdefghijklmnop" for _ in range(6)], "fr": [f"ouè{c}au" for c in "abcdefghijklmnop" for _ in range(6)]}
    say = lambda lang, n: " ".join(rng.choice(tongue[lang]) + str(rng.randrange(400)) for _ in range(n))
    passage, items = say("en", 20), [(1, say("en", 30)), (2, say("fr", 30)), (3, say("en", 5)), (4, None), (5, "")]
    rows = [(i, say("en" if i % 3 else "fr", rng.randrange(20, 90)), "en" if i % 3 else "fr") for i in range(40)]
    base = say("en", 100).split()
    for i in range(40, 60):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), None if i % 2 else "en"))
    rows += [(60 + i, f"{say('fr', 30)} {passage} {say('fr', 9)}", "fr") for i in range(8)]
    rows += [(70 + i, rows[i][1], rows[i][2]) for i in range(4)]
    rows += [(80, f"{say('en', 20)}. {items[0][1].upper()}; {say('en', 6)}", "en"), (81, f"{items[0][1]} {items[1][1]}", "en"), (82, f"({items[2][1]}) {say('en', 30)}", "en")]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 34 --", "en"), (93, say("fr", 12_000), "fr"), (None, say("en", 40), "en"), (5, rows[5][1], "en"), (94, passage, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    left = [(i, t) for i, t, _ in rows if re.search(r"[^\W\d_]", t or "") and model.predict([t.encode()])[1][0] >= corpus_pipeline.SURE]
    assert {90, 91, 92}.isdisjoint(i for i, _ in left) and len(left) > len(rows) - 8
    of = {i: c for i, _, c in plain_components([(i, t, "") for i, t in left], 5, 80)}
    left = [(i, t) for i, t in left if of[i] == i]
    assert len(left) < 65
    left = plain_leaks_gone(plain_repeats_gone(left), items)
    assert 81 not in {i for i, _ in left} and 80 in {i for i, _ in left} and 94 not in {i for i, _ in left}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = Counter((i, tuple([*encode(t or "", add_special_tokens=False).ids, 2])) for i, t in left)
    assert Counter({(i, len(ids)): k for (i, ids), k in want.items()}) == Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    for (i, ids), k in want.items():
        own = [r for r in got if r.doc_id == i and r.doc_tokens == len(ids)]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
        cover = np.zeros(len(ids), int)
        for r in own:
            cover[r.start : r.start + r.length] += 1
        assert (cover == k).all()


def test_stages_take_odd_tables(spark, sf):
    """Empty tables, nulls in every column, and tables without a language go through each stage."""
    schema = "doc_id long, text string, lang string, n_chars long, score double, hits string, hash long"
    for rows in ([], [(None, None, None, None, None, None, None)] * 3, [(1, "some text here", None, 14, 0.5, "x", 1), (None, "other text there", None, 16, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() == (0 if name == "language_id" and rows and rows[0][1] is None else len(rows))


def test_near_copies_of_five_words_go(spark, sf):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    for out, at in ((near, (30, 60)), (far, (20, 45, 70))):
        for i in at:
            out[i] = f"edit{i}"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "other words altogether in this one")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == [1, 3, 4]


def test_texts_stay_where_no_language_is_known(spark, sf):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "ещё", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()) == [1, 4]


def test_sample_draws_on_every_class(spark):
    rows = spark.createDataFrame([(i, f"l{i % 1200}") for i in range(2400)], "doc_id long, lang string")
    assert language_id.balanced_sample(rows, "lang", rows.doc_id, 2400).select("lang").distinct().count() == 1200
