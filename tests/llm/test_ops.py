"""The ten operators against plain versions, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from grovekit.llm import chat_format, decontamination, html_text, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, suffix_dedup
from grovekit.llm.graph import components
from grovekit.llm.rolling import word_ngrams

DOCS = "doc_id long, text string, lang string, source string, score double, n int, unit string, base string, text_key string, bucket int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows (doc_id, text, source): copies, near copies, shared passages, odd rows."""
    rng = random.Random(5)
    out = []
    passage = words(rng, 30)
    base = words(rng, 120, 5000).split()
    for i in range(60):
        out.append((i, words(rng, rng.randrange(1, 200)) + ("\n" + passage if i % 4 == 0 else ""), f"s{i % 3}"))
    for i in range(60, 90):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(10**6)}"
        out.append((i, " ".join(near), "s0"))
    out += [(90 + i, out[7][1], "s1") for i in range(6)]
    out += [(100, None, "s1"), (101, "", None), (102, " \n\t ", "s2"), (103, "one two", "s2"), (104, "ONE two", "s2"), (105, "the the the " * 40, "s2"), (106, "\x00é— ½ Ⅷ 你好 <|endoftext|> it's", "s2")]
    out += [(107, words(rng, 30_000, 50_000), "s0"), (108, "á" * 120, "s1"), (109, "á" * 119 + "b", "s1"), (110, "x" * 49, "s1"), (111, "x" * 49, "s1"), (112, "y" * 50, "s1"), (113, "y" * 50, "s1")]
    out += [(None, out[7][1], "s1"), (None, "lonely text without an id " * 4, "s1"), (7, out[7][1], "s1"), (8, words(rng, 80), "s1"), (8, out[60][1], "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en" if t and "w" in t else None, s, 0.5, 1, "u", "b", "k", 3) for i, t, s in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def test_license_rules(spark, nothing):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "a | b\nReleased under the MIT License."), (3, "Licensed under the Apache License, Version 2.0. All rights reserved."), (4, None), (5, "nothing"), (6, "MIT License. MIT License."), (None, "Licensed under CC BY-NC 4.0."), (3, "All rights reserved.")]
    got = collected(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (1, 2, "mit_grant,mit_notice", "MIT", 1) in got
    assert (2, 1, "mit_ref", "MIT", 1) in got
    assert (3, 2, "apache2_ref,rights_reserved", "ALL-RIGHTS-RESERVED,Apache-2.0", 2) in got and (3, 1, "rights_reserved", "ALL-RIGHTS-RESERVED", 1) in got
    assert (4, 0, "", "", 0) in got and (5, 0, "", "", 0) in got and (None, 1, "cc_by_nc4", "CC-BY-NC-4.0", 1) in got
    assert (6, 2, "mit_ref,mit_ref", "MIT", 1) in got and len(got) == len(rows)
    assert license_scan.scan(nothing).count() == 0


def test_licenses_between_the_parts_of_another_stay(spark):
    mit, bsd2 = ["mit_grant", "mit_notice"], ["bsd_grant", "bsd_source", "bsd_binary"]
    bsd3, gpl = [*bsd2, "bsd_endorse"], ["gpl_redistribute", "gpl_warranty"]
    cases = [
        ([*mit, "mit_warranty", *bsd3, "gpl3_ref", *mit], "BSD-3-Clause,GPL-3.0,MIT"),
        ([*bsd3, "mpl2_ref", *mit, *bsd3], "BSD-3-Clause,MIT,MPL-2.0"),
        ([*bsd2, *bsd3], "BSD-2-Clause,BSD-3-Clause"),
        ([*bsd3, *bsd2], "BSD-2-Clause,BSD-3-Clause"),
        ([*bsd3, "cc0", *bsd2, "mit_ref", *bsd3], "BSD-2-Clause,BSD-3-Clause,CC0-1.0,MIT"),
        ([*bsd2, "gpl2_ref", *bsd2], "BSD-2-Clause,GPL-2.0"),
        (["apache2_ref", "cc_by4", "apache_compliance", "isc_grant", "apache_copy"], "Apache-2.0,CC-BY-4.0,ISC"),
        ([*gpl[:1], "mpl2_ref", *gpl, *gpl], "GPL-3.0-or-later,MPL-2.0"),
        (["mit_grant", *mit, "mit_ref", "mit_ref"], "MIT"),
        (["bsd_grant", "cc0", "cc0", "mit_ref", "cc0"], "CC0-1.0,MIT,UNKNOWN-GRANT"),
    ]
    rows = [(i, ".\n\n".join(license_scan.SENTENCES[x][0] for x in ids) + ".") for i, (ids, _) in enumerate(cases)]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (",".join(ids), names) for i, (ids, names) in enumerate(cases)}


def test_every_sentence_has_a_mark():
    assert all(any(m in s + " " for m in license_scan.MARKS) for own in license_scan.SENTENCES.values() for s in own)


def test_wrapped_and_spaced_sentences_are_found(spark):
    rows = [(1, "All rights\nreserved."), (2, "All rights  reserved"), (3, "# This is free and unencumbered software released into the public\n# domain."), (4, "All\u00a0rights\u00a0reserved!"), (5, "Licensed under\nCC-BY 4.0")]
    got = {r.doc_id: r.sentence_ids for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "rights_reserved", 2: "rights_reserved", 3: "unlicense", 4: "rights_reserved", 5: "cc_by4"}
    assert all(m.isalnum() for m in license_scan.MARKS)
    assert all(any(m in w for m in license_scan.MARKS for w in s.split()) for own in license_scan.SENTENCES.values() for s in own)


# 2


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(1, 9)))
        room, sums = rng.randrange(1, 150), {0}
        for length, k in counts.items():
            sums = {s + j * length for s in sums for j in range(k + 1) if s + j * length <= room}
        got = packing.best_fill(dict(counts), room)
        assert all(got[x] <= counts[x] for x in got) and sum(x * k for x, k in got.items()) == max(sums)


def test_packing(spark, docs, corpus, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_documents(docs, TOKENIZER, window=16).collect()
    want = Counter()
    for i, t, _ in corpus:
        want[(i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2]))] += 1
    pieces, sequences = Counter(), {}
    for r in got:
        pieces[(r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32)] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    # Each copy of a document is a chain of pieces from 0 to its end, and no piece is left over.
    for (i, ids), k in want.items():
        for _ in range(k):
            at = 0
            while at < len(ids):
                fits = (p for p in pieces if p[:3] == (i, len(ids), at) and zlib.crc32(np.array(ids[at : at + p[3]], "<u4").tobytes()) == p[4])
                piece = max(fits, key=lambda p: p[3])
                pieces[piece] -= 1
                pieces += Counter()
                at += piece[3]
            assert at == len(ids)
    assert not pieces
    assert sum(r.length for r in got) == sum(len(ids) * k for (_, ids), k in want.items())
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


def test_ids_of_every_character():
    from tokenizers import Tokenizer

    own, plain = packing.WordTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert own.by_words
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    odd = [c for c in every if c.isalnum() and not plain.normalizer.normalize_str(c).isalnum()]  # letters that end in a mark
    assert "\u0130" in odd and len(odd) > 50
    capitals = [f"{a}{chr(m)}{b}" for a in "AHJKTWYIhjtwy" for m in range(0x300, 0x370) for b in ("", "x", "\u0301")]
    for chars in (odd, capitals, every[: 0x3000 : 3], every[0x3000 :: 97]):
        for at in range(0, len(chars), 200):
            text = " ".join(f"x{c}! {c}. Y{c}, {c}.\n{c}a {c}{c}-" for c in chars[at : at + 200])
            assert np.frombuffer(own([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_other_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    text = "Signs, capitals  and\u0130! two  blanks."
    assert not own.by_words and np.frombuffer(own([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# 3


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "héllo"), (2, 0, "system", "x"), (None, 0, None, "y"), (1, 1, "ann", "hi")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = "".join(r.segment for r in sorted((r for r in got if r.perspective == "ann"), key=lambda r: (r.turn, r.segment_key)))
    assert ann == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nhéllo<|end|>\n"
    for r in got:
        assert r.segment[r.mask_start : r.mask_end] == (r.segment.split("|>\n", 1)[1] if r.chat_role == "assistant" else "") and r.n_chars == len(r.segment)


# 4


def test_hinge_separates():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(40) < (0.5 if i % 2 else 0.2) + 0.3 * (np.arange(40) < 5) * (i % 2)) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    w = quality_classifier.fit_hinge(rows, np.ones(40), y)
    hit = np.mean([(w[:-1][r].sum() + w[-1] > 0) == (v > 0) for r, v in zip(rows, y, strict=True)])
    assert hit > 0.9


def test_quality_is_learnt(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = language_id.held_out(3, 1)
    model = quality_classifier.fit(docs.filter(~held), labels.filter(~held))
    got = quality_classifier.score(docs.filter(held), model).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.93


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == docs.count() and all(0.5 <= r.score <= 1 for r in got)
    none = quality_classifier.fit(nothing, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(nothing, none).count() == 0


# 5


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=1>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id='main'><article><h1>Head &amp; line</h1><p>First  <b>bold</b> text<br>second line<script>var a = "</p>";</script></p><p>It.<div class="ad">Buy &lt;this&gt;</div>
<ul><li>item one<li>item two</ul><form>Name <input></form><section class="comments"><p>Great post, thanks a lot for writing all of this down!</p></section></article></div>
<aside>Related things</aside><footer>&copy; all</footer><!-- <p>hidden</p> --></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (None, None, "<article>cut off &am"), (5, "u", "plain words " * 20), (6, "u", "<p" + "x" * 100_000), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Head & line\n\nFirst bold text second line\n\nIt.\n\nitem one\n\nitem two"
    assert text[2] == text[3] == text[6] == "" and text[None] == "cut off &am" and text[5] == ("plain words " * 20).strip()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


def test_tree_learns_its_table():
    tree = html_text.train()
    rows, kept = html_text.labelled()
    assert [tree(tuple(r)) for r in rows] == kept.astype(bool).tolist() and len(rows) > 200

    def used(node):
        return {node.feature} | used(node.low) | used(node.high) if node.feature >= 0 else set()

    assert tree.feature == 3 and used(tree) & {0, 4} and used(tree) & {1, 5} and 2 in used(tree)  # own link density first; words and densities beside it


def test_main_text_of_odd_pages(spark, nothing):
    p = "The quick fox went on to describe in some detail what it saw along the way home that evening, and slept."
    tree = html_text.train()
    cases = [
        (f"<div><a>Home</a> <a>About</a> <a>News</a></div><p>{p}</p><p>{p}</p>", f"{p}\n\n{p}"),
        (f'<div class="post"><h1>Title here</h1><p>{p}</p><p><a>one two</a> <a>three four</a> <a>five</a></p><p>{p}</p></div>', f"Title here\n\n{p}\n\n{p}"),
        (f'<div class="tags-page"><article><h1>T</h1><p>{p}</p></article></div>', f"T\n\n{p}"),
        (f'<div class="social-studies"><h2>Topic</h2><p>{p}</p><p>{p}</p></div>', f"Topic\n\n{p}\n\n{p}"),
        (f'<article><div class="article-header"><h1>Mine</h1><p class="byline">By A</p></div><p>{p}</p></article>', f"Mine\n\n{p}"),
        (f'<div class="page-header"><h1>Site</h1></div><main><p>{p}</p></main><section class="comments"><article><p>{p} {p}</p></article></section><aside>{p}</aside>', p),
        (f'<div id="content"><h2>Story</h2><p>{p}</p><form>{p}</form></div><div id="sidebar">{p}</div><div class="cookie-notice">{p}</div>', f"Story\n\n{p}"),
    ]
    for page, want in cases:
        assert html_text.main_text(page, tree) == want
    start = time.time()
    for tag in ("<div>", '<div class="ad">'):
        html_text.main_text(tag * 50_000 + "</b>" * 50_000 + "x", tree)
    assert time.time() - start < 20  # quadratic time would be minutes
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def plain_main_text(tree, root):
    """Main text of a page given as nested (tag, name, children), by looking at all ancestors of each block."""
    blocks, order = [], []

    def walk(node, above):
        if isinstance(node, str):
            blocks[-1][1].append((node, any(x[0] == "a" for x in above)))
            return
        order.append(node)
        if node[0] not in html_text.INLINE:
            blocks.append((above + [node], []))
        for child in node[2]:
            walk(child, above + [node])
        if node[0] not in html_text.INLINE:
            blocks.append((above, []))

    blocks.append(([], []))
    walk(root, [])
    own = []
    for above, texts in blocks:
        w = " ".join(t for t, _ in texts).split()
        if w:
            own.append((above, w, sum(len(t.split()) for t, linked in texts if linked) / len(w)))
    heads = [next((n for n in order if n[0] in tags), None) for tags in (("h1",), ("article", "main"))]

    def counts(node, above):
        if node[0] in ("nav", "aside", "footer"):
            return True
        if node[1] not in ("ad", "sidebar", "comments"):
            return False
        holds = any(any(x is node for x in a) and len(w) >= 20 and d < 0.5 for a, w, d in own)
        first = any(h is not None and (h is node or any(x is h for x in below(node))) for h in heads)
        return not (holds and first)

    def below(node):
        return [] if isinstance(node, str) else [y for x in node[2] if not isinstance(x, str) for y in [x, *below(x)]]

    shape = [(len(w), d) for _, w, d in own]
    kept = []
    for (above, w, d), x, y in zip(own, [(0, 0.0), *shape], [*shape[1:], (0, 0.0)], strict=False):
        named = any(counts(n, above) for n in above)
        content = any(n[0] in ("article", "main") or n[1] == "post" for n in above)
        heading = any(n[0] in html_text.HEADINGS for n in above)
        if tree((*x, len(w), d, *y, int(named), int(content), int(heading))):
            kept.append(" ".join(w))
    return "\n\n".join(kept)


def test_main_text_as_plain():
    rng, tree = random.Random(8), html_text.train()

    def grow(depth):
        tag = rng.choice(["div", "div", "section", "p", "h1", "h2", "ul", "article", "main", "nav", "aside", "footer", "b", "a"])
        inner = [words(rng, rng.choice([1, 2, 5, 9, 15, 30, 60])) if depth == 0 or rng.random() < 0.5 else grow(depth - 1) for _ in range(rng.randrange(1, 4))]
        return (tag, rng.choice(["", "", "", "ad", "sidebar", "comments", "post", "plain"]) if tag in ("div", "section") else "", inner)

    def render(node):
        if isinstance(node, str):
            return f" {node} "
        name = f' class="{node[1]}"' if node[1] else ""
        return f"<{node[0]}{name}>{''.join(map(render, node[2]))}</{node[0]}>"

    some = 0
    for _ in range(400):
        root = ("body", "", [grow(4) for _ in range(rng.randrange(1, 5))])
        want = plain_main_text(tree, root)
        some += bool(want)
        assert html_text.main_text(render(root), tree) == want
    assert some > 200


# 6


def plain_dedup(rows, length=50):
    out, starts = [], {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            starts[k] = min(starts.get(k, suffix_dedup.LAST), suffix_dedup.LAST if i is None else i)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] < (suffix_dedup.LAST if i is None else i):
                gone[s : s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings(docs, corpus, nothing):
    assert collected(suffix_dedup.report(docs)) == plain_dedup(corpus)
    assert suffix_dedup.report(nothing).count() == 0 and suffix_dedup.remove_repeats(nothing).columns == nothing.columns


def test_passages_repeated_inside_and_across_documents(spark):
    """A passage twice in the document that has it first, equal contexts in one task, and copies in other partitions."""
    rng = random.Random(6)
    passage = words(rng, 20)
    rows = [(i, f"{passage}\n{passage}" if i % 3 else f"{words(rng, 30)} {passage} {words(rng, 9)} {passage}", "") for i in range(24)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for n in (1, 5):
        assert collected(suffix_dedup.report(df.repartition(n))) == plain_dedup(rows)


def test_removal_keeps_rows_and_columns(docs, corpus):
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    left = got.groupBy("doc_id").count().collect()
    texts = {r.doc_id: r.text for r in got.filter("doc_id < 60 or doc_id in (100, 101, 109)").collect()}
    assert texts[0] == corpus[0][1] and texts[100] is None and texts[101] == ""
    assert not any(r.doc_id in range(90, 96) for r in left)
    assert texts[109] == "b"


def test_loser_tree():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 8):
        runs = []
        for _ in range(k):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randrange(1, 30)))
            runs.append((s, [0] + [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(s, s[1:], strict=False)]))
        order, common = suffix_dedup.merge_runs(runs)
        out = [runs[r][0][i] for r, i in order]
        assert out == sorted(x for s, _ in runs for x in s)
        assert common[1:] == [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(out, out[1:], strict=False)]


def test_marks_hit_every_string():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 300)]
    who, at, _ = suffix_dedup.marks(texts)
    for t, text in enumerate(texts):
        own = at[who == t]
        for s in range(len(text) - 49):
            assert ((own >= s) & (own + suffix_dedup.K <= s + 50)).any()


def test_intervals_spread_over_places():
    uid = np.concatenate([(np.int64(p) << 36) + np.arange(0, 4096, 64) for p in range(200)])
    parts = [(b, np.frombuffer(d, np.int64).reshape(-1, 3)) for r in suffix_dedup._dealt(uid, uid * 0, uid * 0 + 50, 64) for b, d in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
    assert sorted(u for _, d in parts for u in d[:, 0].tolist()) == sorted(uid.tolist())
    assert len({b for b, _ in parts}) > 50 and max(len(d) for _, d in parts) < len(uid) // 8
    assert sum(len(set((d[:, 0] >> 12).tolist())) for _, d in parts) == 200


# 7


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_leaks(rows, items, n=8):
    windows = {}
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - n + 1)):
            if w and item is not None:
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for i, t, _ in rows:
        w = plain_words(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if own := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    w, long = corpus[3][1].split(), next(t for i, t, _ in corpus if i == 107).split()
    items = [(1, " ".join(long[5:25])), (2, " ".join(long[29_990:30_000]).upper()), (10, "one two"), (3, corpus[0][1].split("\n")[1]), (3, corpus[0][1].split("\n")[1]), (4, None), (5, ""), (None, corpus[1][1]), (6, " ".join(w[: len(w) // 2]))]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_leaks(docs, corpus, benchmark, nothing):
    items, df = benchmark
    want = plain_leaks(corpus, items)
    assert any(r[5] for r in want) and collected(decontamination.score(docs, df)) == want
    assert decontamination.score(nothing, df).count() == 0
    assert {r.n_items for r in decontamination.score(docs, df.limit(0)).collect()} == {0}


def test_leaks_leave(docs, corpus, benchmark):
    items, df = benchmark
    want = {r[0]: r for r in plain_leaks(corpus, items)}
    got = decontamination.decontaminate(docs, df)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert 107 not in texts and texts[2] == corpus[2][1] and texts[100] is None
    assert texts[103] == "" and len(plain_words(texts[4])) == want[4][1] - want[4][2]


def test_beyond_the_broadcast_bound(docs, corpus, benchmark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert collected(decontamination.score(docs, benchmark[1])) == plain_leaks(corpus, benchmark[0])


# 8


def test_languages(spark, sf, docs, nothing):
    known = spark.read.parquet(f"{sf}/documents.parquet")
    held = language_id.held_out(4, 2)
    model = language_id.fit(known.filter(~held))
    got = language_id.predict(known.filter(held), model, "doc_id", "text", "lang").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert odd[100].lang_pred == odd[101].lang_pred == odd[102].lang_pred == "und" and odd[100].score == 0 and odd[103].lang_pred != "und"
    assert language_id.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(nothing)).collect()} == {"und"}


# 9


def plain_components(rows, n=4, percent=85):
    sets, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("small", [16, 1])
def test_near_copies(docs, corpus, nothing, small):
    want = plain_components(corpus)
    assert len({r[2] for r in want}) < len(want) - 20
    assert collected(jaccard_join.join_components(docs, small=small)) == want
    assert jaccard_join.join_components(nothing).count() == 0


def test_a_family_of_near_copies_costs_rows_by_its_size(spark, monkeypatch):
    """A thousand near copies, strays beside them, small blocks: the same components, and no pairs of the family leave."""
    rng = random.Random(12)
    base = words(rng, 60, 5000).split()
    rows = []
    for i in range(1000):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), ""))
    rows += [(2000 + i, " ".join(base[:40] + words(rng, 20, 5000).split()), "") for i in range(60)]
    monkeypatch.setattr(jaccard_join, "BLOCK_UNITS", 150)
    made = []
    cut = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: made.append((df.columns, (out := cut(df)).count())) or out)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    assert collected(jaccard_join.join_components(df)) == plain_components(rows)
    assert max(n for columns, n in made if columns == ["a", "b"]) < 20_000


def test_short_texts_link(spark):
    rows = [(i, f"tiny text {i // 3}", "") for i in range(30)] + [(50 + i, "a b c d e f g h i j k l m n o p q r s t u v w x"[: 47 - 2 * (i % 3)], "") for i in range(9)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert collected(jaccard_join.join_components(df, small=1)) == plain_components(rows)


def test_dense_and_sparse_overlaps(monkeypatch):
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(200) for _ in range(80)], np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]
    assert jaccard_join._overlaps(sets[:10], sets[10:]).tolist() == want
    monkeypatch.setattr(jaccard_join, "DENSE_CELLS", 0)
    assert jaccard_join._overlaps(sets[:10], sets[10:]).tolist() == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (40, 39)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngrams_are_sets():
    got = word_ngrams([b"a b c d e", b"a b c d", b"a b", b"b a", b"", b"  a\tb\x0bc\nd  "], 4)
    assert [len(g) for g in got] == [2, 1, 1, 1, 0, 1] and got[1][0] in got[0] and got[5][0] == got[1][0] and got[2][0] != got[3][0]


# 10


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rules(docs, corpus, nothing):
    got = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted(((i, *plain_measures(t)) for i, t, _ in corpus), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "bad"
    rows = [(i, bad if i % 10 else good, "spam") for i in range(200)] + [(1000 + i, good, "fine") for i in range(300)] + [(2000, good, "new"), (2001, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0] and got[1000] and got[2000] and got[2001]


def test_hosts_beyond_the_broadcast_bound(docs, monkeypatch):
    want = collected(quality_rules.judge(docs))
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 0)
    assert collected(quality_rules.judge(docs)) == want
