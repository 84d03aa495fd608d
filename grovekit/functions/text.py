"""Scalar text functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
STOP_PHRASES = ("the", "this", "that", "table", "figure")
NOT_ANSWERABLE_GOLD = ("not answerable", "none", "nan", "")
NOT_ANSWERABLE_PREDICTED = ("not answerable", "none", "unknown", "unanswerable", "")
PHRASE = r"\b[A-Z][A-Za-z0-9%/-]*(?:\s+[A-Z][A-Za-z0-9%/-]*){0,4}\b"
ASCII_PHRASE = r"[A-Z][A-Za-z0-9%/-]*(?: [A-Z][A-Za-z0-9%/-]*){0,4}"
FALLBACK_PHRASE = r"[一-鿿A-Za-z0-9][一-鿿A-Za-z0-9%/-]{2,20}"
# Runs of other signs and articles, but for a blank alone, which needs no change (each one costs far more than the search).
# Articles are told by their letters first, and the loops never go back, so long runs are safe.
DROPPED = r"(?! (?!(?:an?|the)(?![a-z0-9]))[a-z0-9.%/-])(?:[^a-z0-9.%/-]++|(?:a(?<![a-z0-9]a)n?|t(?<![a-z0-9]t)he)(?![a-z0-9]))++"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?%?"
IMAGE_KEYWORDS = ("figure", "fig.", "image", "table")
TABLE_KEYWORDS = ("table", "tab.")
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
LINK_WEIGHTS = {"page": 0.40, "similarity": 0.30, "order": 0.20, "mention": 0.10}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """A double, null where it is no number."""
    return F.when(~F.isnan(_col(c)), _col(c))


def almost_equal(a: Column | str, b: Column | str, tolerance: float = 1e-6) -> Column:
    """Whether two maps to doubles have the same keys and values within the tolerance."""
    a, b = _col(a), _col(b)
    near = F.forall(F.map_keys(a), lambda k: F.abs(F.try_element_at(a, k) - F.try_element_at(b, k)) <= tolerance)
    return (F.size(a) == F.size(b)) & F.coalesce(near, F.lit(False))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, as ``str.strip`` does."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def not_empty(c: Column | str) -> Column:
    return F.nullif(_col(c).cast("string"), F.lit(""))


def first_value(*cols: Column | str, default: Column | None = None) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[not_empty(c) for c in cols], default if default is not None else F.lit(None))


def clean_str(c: Column | str) -> Column:
    """Strip, decode the five basic character references, drop control characters."""
    out = strip(c)
    for name, sign in HTML_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def is_float(c: Column | str) -> Column:
    return _col(c).rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def split_markers(c: Column | str, *markers: str) -> Column:
    """Split at any of the literal markers; parts are stripped, blank ones dropped."""
    parts = F.split(_col(c), "|".join("\\Q" + m + "\\E" for m in markers)) if markers else F.array(_col(c))
    return F.filter(F.transform(parts, strip), lambda x: x != "") if markers else parts


def quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(_col(c), r'^"+|"+$', ""), F.lit('"'))


def parse_number(c: Column | str) -> Column:
    """Double, or null where the string is no number."""
    return F.expr("try_cast(x as double)") if c is None else _col(c).try_cast("double")


def value_kind(c: Column | str) -> Column:
    """Kind of a scalar written as text: null, bool, int, float or string."""
    s = strip(c)
    return (
        F.when(s == "null", "null").when(s.isin("true", "false"), "bool").when(s.rlike(r"^[-+]?\d+$"), "int").when(s.rlike(r"^[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?$"), "float").otherwise("string")
    )


def fold_ascii(c: Column | str) -> Column:
    """Lower case, but only of strings that are ASCII throughout."""
    return F.when(_col(c).rlike(r"^\p{ASCII}*$"), F.lower(_col(c))).otherwise(_col(c))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, keep letters, digits and ``.%/-``, drop articles, squeeze blanks."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), DROPPED, " "))


def tokens(c: Column | str) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def token_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def numbers(c: Column | str) -> Column:
    """Numbers in a text; a percentage counts a hundredth."""
    raw = F.regexp_extract_all(_col(c), F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(x, "[,%]", "").try_cast("double") * F.when(x.endswith("%"), 0.01).otherwise(1.0))


def close_number(left: Column, right: Column) -> Column:
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-3) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-3))
    return near(left, right) | near(left, right * 0.01)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def numeric_match(gold: Column | str, predicted: Column | str) -> Column:
    """Whether a number of the one is close to a number of the other."""
    found = F.struct(numbers(gold).alias("g"), numbers(predicted).alias("p"))
    return let(found, lambda n: F.exists(n["g"], lambda x: F.exists(n["p"], lambda y: close_number(x, y)))).cast("double")


def _numbered(words: Column) -> Column:
    """Words in order, each with the number of its occurrence, so that a multiset becomes a set."""
    return let(F.array_sort(words), lambda o: F.transform(o, lambda w, i: F.concat_ws("#", w, (i - F.array_position(o, w)).cast("string"))))


def token_f1(gold: Column | str, predicted: Column | str) -> Column:
    """F1 of the multisets of normalised words."""
    return _word_f1(normalize_answer(gold), normalize_answer(predicted))


def _word_f1(gold: Column, predicted: Column) -> Column:
    def score(g: Column, p: Column) -> Column:
        common = F.size(F.array_intersect(_numbered(g), _numbered(p)))
        both = (F.size(g) > 0) & (F.size(p) > 0)
        return F.when(~both, ((F.size(g) == 0) & (F.size(p) == 0)).cast("double")).otherwise(F.lit(2.0) * common / (F.size(g) + F.size(p)))

    words = F.struct(tokens(gold).alias("g"), tokens(predicted).alias("p"))
    return let(words, lambda x: score(x["g"], x["p"]))


def list_f1(gold_items: Column, predicted: Column | str) -> Column:
    """F1 of a greedy one-to-one match; items match if equal or one holds the other."""
    fits = lambda x, y: (x == y) | F.contains(x, y) | F.contains(y, x)

    def score(g: Column, p: Column) -> Column:
        places = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        first = lambda left, x: F.get(F.filter(left, lambda i: fits(x, F.get(p, i))), F.lit(0))
        left = F.aggregate(g, places, lambda left, x: F.coalesce(F.array_remove(left, first(left, x)), left))
        return F.when(F.size(g) == 0, 0.0).otherwise(F.lit(2.0) * (F.size(p) - F.size(left)) / (F.size(g) + F.size(p)))

    said = F.filter(F.transform(F.split(_col(predicted), r"[,;\n]|\band\b"), normalize_answer), lambda x: x != "")
    items = F.struct(F.transform(gold_items, normalize_answer).alias("g"), said.alias("p"))
    return let(items, lambda x: score(x["g"], x["p"]))


def answer_scores(gold: Column | str, predicted: Column | str, answer_format: Column | str) -> list[Column]:
    """``answer_score, exact_match, token_f1, numeric_match, list_f1`` of a gold answer and a prediction."""
    g, p, kind = F.coalesce(_col(gold), F.lit("")), F.coalesce(_col(predicted), F.lit("")), _col(answer_format)
    unanswerable = normalize_answer(g).isin(*NOT_ANSWERABLE_GOLD)
    declined = normalize_answer(p).isin(*NOT_ANSWERABLE_PREDICTED).cast("double")
    exact = F.when(unanswerable, declined).otherwise((normalize_answer(g) == normalize_answer(p)).cast("double"))
    f1 = F.when(unanswerable, declined).otherwise(token_f1(g, p))
    by_number = F.when(kind.isin("Int", "Float"), numeric_match(g, p))
    by_items = F.when(kind == "List", list_f1(parse_list(g), p))

    # What only some formats need is worked out for these alone, and nothing twice.
    def score_of(gold: Column) -> Column:
        by_words = let(normalize_answer(p), lambda said: F.greatest((gold == said).cast("double"), _word_f1(gold, said)))
        return F.when(gold.isin(*NOT_ANSWERABLE_GOLD), declined).otherwise(F.coalesce(by_items, by_number, by_words))

    score = let(normalize_answer(g), score_of)
    number, items = F.when(~unanswerable, by_number), F.when(~unanswerable, by_items)
    return [score.alias("answer_score"), exact.alias("exact_match"), f1.alias("token_f1"), number.alias("numeric_match"), items.alias("list_f1")]


def parse_list(c: Column | str) -> Column:
    """A list written as text; null, blank, ``nan`` and ``none`` are empty, any other text is its one item."""

    def items(s: Column) -> Column:
        parsed = F.from_json(F.translate(s, "'", '"'), "array<string>")
        return F.when(F.lower(s).isin("", "nan", "none"), F.array().cast("array<string>")).when(s.startswith("["), F.coalesce(parsed, F.array(s))).otherwise(F.array(s))

    return let(F.coalesce(strip(c), F.lit("")), items)


def clean_scalar(c: Column | str) -> Column:
    s = strip(_col(c).cast("string"))
    return F.when(~F.lower(s).isin("", "nan", "none"), s)


def page_score(media_page: Column, chunk_page: Column, window: int = 1) -> Column:
    gap = F.abs(media_page - chunk_page)
    return F.when(gap.isNull(), 0.5).when(gap > window, 0.0).otherwise(1.0 - gap / (window + 1))


def order_score(media_index: Column, chunk_order: Column, n_chunks: Column) -> Column:
    near = 1.0 - F.abs(chunk_order - F.least(n_chunks - 1, media_index)) / F.greatest(n_chunks, F.lit(1))
    return F.when(n_chunks <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), near))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("([A-Za-z0-9_%-]+)"), F.lit(1)))


def mention_score(text: Column | str, media_text: Column | str, modality: Column | str) -> Column:
    """1 where the text names the kind of media, plus a twentieth for each shared word, at most 1."""
    return mention_of(names_kind(text, IMAGE_KEYWORDS), names_kind(text, TABLE_KEYWORDS), word_set(text), word_set(media_text), _col(modality))


def names_kind(text: Column | str, words: tuple[str, ...]) -> Column:
    low = F.lower(_col(text))
    return F.lit(False) if not words else F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def mention_of(image: Column, table: Column, words: Column, media_words: Column, modality: Column) -> Column:
    """``mention_score`` from what is known of each side, so that texts are read once and not once a pair."""
    named = F.when(modality == "image", image).otherwise(table).cast("double")
    return F.least(F.lit(1.0), named + F.size(F.array_intersect(words, media_words)) / 20.0)


def link_score(page: Column, similarity: Column, order: Column, mention: Column) -> Column:
    w = LINK_WEIGHTS
    return w["page"] * page + w["similarity"] * similarity + w["order"] * order + w["mention"] * mention


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, clamp: bool = False) -> Column:
    value = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value


def split_ids(c: Column | str) -> Column:
    """Ids packed with bars."""
    return F.filter(F.transform(F.split(_col(c), r"\|"), strip), lambda x: x != "")


def joined_parts(*cols: Column | str, sep: str = "\n") -> Column:
    """Parts that aren't empty, joined."""
    return F.concat_ws(sep, *[not_empty(c) for c in cols])


def args_hash(*cols: Column | str) -> Column:
    return F.md5(F.to_json(F.struct(*[_col(c).alias(f"a{i}") for i, c in enumerate(cols)])).cast("binary"))


def content_id(*cols: Column | str, prefix: str = "") -> Column:
    """``prefix`` and the md5 of the values joined by bars; null prints as None."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("None")) for c in cols]).cast("binary")))


def tree_depth(n: Column | str, fanout: int = 20) -> Column:
    """Levels that ``n`` nodes need; halves round to even."""
    return (F.bround(F.log(_col(n).cast("double")) / math.log(fanout)) + 1).cast("int")


def judged_score(c: Column | str) -> Column:
    """Score from 0 to 1 in a judge's answer; a bare ``d.d`` will do; -1 where there is none."""
    s = _col(c)
    given = F.regexp_extract(s, r'"score"\s*:\s*(\d*\.?\d+)', 1).try_cast("double")
    reason = s.rlike(r'"rationale"\s*:\s*"((?:\\"|[^"])*)"')
    bare = F.regexp_extract(s, r"\b(\d\.\d)\b", 1).try_cast("double")
    return F.when(given.between(0, 1) & reason, given).when(bare.between(0, 1), bare).otherwise(-1.0)


def judged_reason(c: Column | str) -> Column:
    s = _col(c)
    full = F.replace(F.regexp_extract(s, r'"rationale"\s*:\s*"((?:\\"|[^"])*)"', 1), F.lit('\\"'), F.lit('"'))
    found = F.coalesce(F.nullif(F.regexp_extract(s, r'"([^"]+)"', 1), F.lit("")), F.lit("Partial match found"))
    strict = s.rlike(r'"score"\s*:\s*(\d*\.?\d+)') & s.rlike(r'"rationale"\s*:\s*"')
    return F.when(judged_score(c) < 0, F.lit("Parsing failed")).when(strict, full).otherwise(found)


def triple_parts(c: Column | str) -> Column:
    """Fields of a tab-packed triple, without angle brackets."""
    return F.transform(F.split(_col(c), "\t"), lambda x: F.trim(F.translate(x, "<>", "")))


def truncate_tokens(c: Column | str, n: int) -> Column:
    """At most the first ``n`` words."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def page_number(c: Column | str, zero_based: bool = True) -> Column:
    """A page as an integer; zero-based pages move up by one, others only from 0 to 1."""
    n = _col(c).cast("string").try_cast("int")
    return n + 1 if zero_based else F.when(n == 0, 1).otherwise(n)


def bbox(c: Column | str) -> Column:
    """First four numbers, or null if there are fewer."""
    four = F.transform(F.slice(_col(c), 1, 4), lambda x: x.cast("string").try_cast("double"))
    return F.when((F.size(_col(c)) >= 4) & ~F.exists(four, lambda x: x.isNull()), four)


def item_type(c: Column | str) -> Column:
    low = F.lower(F.coalesce(_col(c), F.lit("text")))
    return F.when(F.contains(low, F.lit("table")), "table").when(low.rlike("image|img|figure"), "image").otherwise("text")


def looks_like_heading(c: Column | str) -> Column:
    s = strip(c)
    return (s != "") & (F.length(s) < 120) & (s.startswith("#") | s.rlike(r"^\d+(\.\d+)*\s+\S+"))


def summary_240(c: Column | str) -> Column:
    """Squeezed text of at most 240 characters, cut with an ellipsis."""
    s = squeeze(c)
    return F.when(F.length(s) <= 240, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, 237)), F.lit("…")))


def media_summary(kind: Column, caption: Column, ocr: Column, table: Column, footnote: Column) -> Column:
    """Labelled parts in one line of at most 1000 characters; a stock phrase if there are none."""
    labelled = lambda name, c: F.concat(F.lit(f"{name}: "), not_empty(c))
    s = squeeze(F.concat_ws(" ", labelled("Caption", caption), labelled("OCR", ocr), not_empty(table), labelled("Footnote", footnote)))
    return F.when(s == "", F.concat(kind, F.lit(" evidence"))).when(F.length(s) > 1000, F.concat(F.substring(s, 1, 997), F.lit("..."))).otherwise(s)


def without_brackets(c: Column | str, strong: bool = False) -> Column:
    """Text without round brackets and what they hold; ``strong`` also trims what is no ASCII letter at both ends."""
    out = F.regexp_replace(_col(c), r"[(（][^)）]*[)）]", "")
    return F.regexp_replace(out, r"^[^a-zA-Z]+|[^a-zA-Z]+$", "") if strong else out


def half_width(c: Column | str) -> Column:
    """Full-width forms of ASCII, and the wide blank, as their plain characters."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(_col(c), wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def word_bounded(text: Column | str, word: Column | str) -> Column:
    """Whether the word occurs with no letter, digit or underscore right beside it."""
    quoted_word = F.concat(F.lit(r"(?U)(?<!\w)\Q"), _col(word), F.lit(r"\E(?!\w)"))
    return F.regexp_like(_col(text), quoted_word)


def sentence_around(text: Column | str, word: Column | str, width: int = 300) -> Column:
    """First sentence that holds the word, else the start of the text."""
    holding = F.filter(F.split(_col(text), r"(?<=[.!?。！？])\s+"), lambda s: F.contains(s, _col(word)))
    return F.substring(F.coalesce(F.get(holding, F.lit(0)), _col(text)), 1, width)


def candidate_entities(text: Column | str, limit: int | None = 8, ascii_safe: bool = False) -> Column:
    """Capitalised phrases of at most five words, first seen first; other words if there are none. ``limit`` None gives all."""
    found = F.regexp_extract_all(_col(text), F.lit(f"({ASCII_PHRASE if ascii_safe else PHRASE})"), F.lit(1))
    if not ascii_safe:
        found = F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all(_col(text), F.lit(f"({FALLBACK_PHRASE})"), F.lit(1)))
    kept = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*STOP_PHRASES))  # not F.trim itself: it would take the place for the characters to trim
    seen = F.array_distinct(kept)
    return F.slice(seen, 1, limit) if limit else seen
