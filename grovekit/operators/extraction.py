"""Entities, relations and triples out of texts and model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text as T
from grovekit.operators.merging import broadcast_small

# Marks of the record format.
RECORD, COMPLETE, FIELD = "##", "<|COMPLETE|>", "<|>"


def mentions(chunks: DataFrame, limit: int | None = 8, ascii_safe: bool = False, id_col: str = "hash_code", text_col: str = "text") -> DataFrame:
    """``source_id, pos, entity_name`` of the candidate entities of each chunk, in order."""
    found = T.candidate_entities(text_col, limit, ascii_safe)
    return chunks.select(F.col(id_col).alias("source_id"), F.posexplode(found).alias("pos", "entity_name"))


def cooccurrences(chunks: DataFrame, limit: int | None = 8, ascii_safe: bool = False, id_col: str = "hash_code", text_col: str = "text") -> DataFrame:
    """``source_id, pos, src, dst, description`` of neighbouring candidates in each chunk; no join or shuffle."""
    names = T.candidate_entities(text_col, limit, ascii_safe)
    rows = chunks.select(F.col(id_col).alias("source_id"), names.alias("n"))
    pairs = F.arrays_zip(F.slice("n", 1, F.greatest(F.size("n") - 1, F.lit(0))).alias("src"), F.slice("n", 2, F.greatest(F.size("n") - 1, F.lit(0))).alias("dst"))
    out = rows.select("source_id", F.posexplode(pairs).alias("pos", "p")).select("source_id", "pos", F.col("p.src").alias("src"), F.col("p.dst").alias("dst"))
    return out.withColumn("description", F.concat("src", F.lit(" and "), "dst", F.lit(" co-occur in the same text chunk.")))


def heuristic_entities(chunks: DataFrame, order: str = "ord", limit: int = 8, width: int = 500) -> DataFrame:
    """Entities without a model: distinct source ids in order, and a description that grows sentence by sentence until it has ``width`` characters."""
    names = T.candidate_entities("text", limit)
    cited = F.transform(names, lambda n: F.struct(n.alias("entity_name"), T.sentence_around(F.col("text"), n).alias("sentence")))  # before the rows are dealt
    rows = chunks.select("hash_code", F.col(order).alias("ord"), F.posexplode(cited).alias("pos", "c")).select("hash_code", "ord", "pos", "c.*")
    # A description is full after ``width`` sentences at most, so that no more are gathered for a common name.
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("entity_name").orderBy("ord", "pos"))).filter(F.col("__n") <= width)
    told = first.groupBy("entity_name").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "sentence"))).alias("s"))
    description = F.aggregate("s", F.lit(""), lambda acc, x: F.when(F.length(acc) < width, F.trim(F.concat(acc, F.lit(" "), x["sentence"]))).otherwise(acc))
    ids = rows.groupBy("entity_name", "hash_code").agg(F.min(F.struct("ord", "pos")).alias("o"))
    ids = ids.groupBy("entity_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "hash_code"))), lambda x: x["hash_code"]).alias("source_ids"))
    return told.join(ids, "entity_name").select("entity_name", F.lit("CONCEPT").alias("entity_type"), description.alias("description"), "source_ids", F.lit(0).alias("degree"))


def document_entity(entities: DataFrame, chunks: DataFrame, name: str = "document") -> DataFrame:
    """``entities``, or the document itself as the one entity where there is none."""
    none = entities.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    ids = chunks.agg(F.slice(F.array_sort(F.collect_set("hash_code")), 1, 5).alias("source_ids"))
    row = ids.join(F.broadcast(none), F.lit(True), "left_semi").select(F.lit(name).alias("entity_name"), F.lit("CONCEPT").alias("entity_type"), F.lit(name).alias("description"), "source_ids", F.lit(0).alias("degree"))
    return entities.unionByName(row)


def with_chunk_text(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """``triples`` with the ``text`` of their chunk, empty where the chunk is unknown."""
    texts = chunks.groupBy(F.col("hash_code").alias("source_id")).agg(F.max("text").alias("text"))
    return triples.join(texts, "source_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def keep_sources(rows: DataFrame, mark: str, cap: int = 20_000, order: str = "ord", col: str = "source_id") -> DataFrame:
    """Of the first ``cap`` rows those whose source id holds the mark."""
    return rows.orderBy(order).limit(cap).filter(F.contains(F.col(col), F.lit(mark)))


def records(answers: DataFrame, text_col: str = "answer", key_col: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of answers in the record format.

    A record stands in brackets; names and types are upper-cased and cleaned. An
    entity needs four fields, a relation five; a relation's last field is its
    weight if it is a number, else 1.
    """
    parts = answers.select(F.col(key_col).alias("source_id"), F.posexplode(T.split_markers(text_col, RECORD, COMPLETE)).alias("ord", "record"))
    fields = T.split_markers(F.regexp_extract("record", r"\((.*)\)", 1), FIELD)
    rows = parts.filter(F.col("record").rlike(r"\((.*)\)")).select("source_id", "ord", fields.alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    name = lambda i: T.clean_str(F.upper(get(i)))
    entities = rows.filter((F.size("f") >= 4) & (get(0) == '"entity"')).select("source_id", "ord", name(1).alias("entity_name"), name(2).alias("entity_type"), T.clean_str(get(3)).alias("description"))
    last = F.element_at("f", -1)
    weight = F.when(T.is_float(last), last.try_cast("double")).otherwise(1.0)
    relations = rows.filter((F.size("f") >= 5) & (get(0) == '"relationship"')).select("source_id", "ord", name(1).alias("src"), name(2).alias("dst"), weight.alias("weight"), T.clean_str(get(3)).alias("description"))
    return entities.filter("entity_name <> ''"), relations


def pipe_triples(answers: DataFrame, text_col: str = "answer", entities_col: str | None = None) -> DataFrame:
    """Triples written ``head | relation | tail`` a line, numbered or not.

    With entities (an array column), heads outside them are dropped, by case-blind
    comparison; without, triples whose head is their tail. Each triple once.
    """
    keep = [c for c in answers.columns if c != text_col]
    line = F.regexp_replace("line", r"^\d+\.\s*", "")
    side = lambda i: F.trim(F.regexp_replace(F.trim(F.get("p", F.lit(i))), r"^<+|>+$", ""))
    rows = answers.select(*keep, F.explode(F.split(text_col, "\n")).alias("line")).withColumn("p", F.split(line, r"\|")).filter(F.size("p") == 3)
    rows = rows.select(*keep, side(0).alias("head"), side(1).alias("relation"), side(2).alias("tail"))
    if entities_col:
        rows = rows.filter(F.array_contains(F.transform(entities_col, F.lower), F.lower("head")))
    else:
        rows = rows.filter("head <> tail")
    return rows.dropDuplicates([*[c for c in keep if c != entities_col], "head", "relation", "tail"])


def described_triples(rows: DataFrame, triple_col: str = "triple", answer_col: str = "answer") -> DataFrame:
    """Triples with what a model said of their parts; unread answers leave the descriptions null."""
    part = "struct<description: string, type: string>"
    said = F.from_json(F.trim(answer_col), f"struct<subject: {part}, relation: {part}, object: {part}>")
    t = T.triple_parts(triple_col)
    out = rows.withColumn("__s", said).withColumn("__t", t)
    at = lambda i: F.get("__t", F.lit(i))
    return out.select(
        *rows.columns, at(0).alias("head"), F.col("__s.subject.description").alias("head_desc"), F.col("__s.subject.type").alias("head_type"), at(1).alias("relation"), F.col("__s.relation.description").alias("relation_desc"), at(2).alias("tail"),
        F.col("__s.object.description").alias("tail_desc"), F.col("__s.object.type").alias("tail_type"),
    )


def unwrap(c: Column | str) -> Column:
    """A field without its first and last character."""
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(col, F.lit(2), F.length(col) - 2)


def fold_ends(triples: DataFrame) -> DataFrame:
    """Two entity rows of each triple, the head's first."""
    e = lambda n, side: F.struct(F.col(n).alias("entity_name"), F.col(f"{n}_desc").alias("description"), F.col(f"{n}_type").alias("entity_type"), F.lit(side).alias("side"))
    return triples.select("source_id", "ord", F.inline(F.array(e("head", 0), e("tail", 1))))


def entities_of_triples(triples: DataFrame, col: str = "head", order: str = "ord") -> DataFrame:
    """Names in the order of a file of triples, signs stripped and underscores made blanks; repeats in a row count once.

    One equi-join of the rows with the rows before them, by gapless ordinals.
    """
    name = F.trim(F.regexp_replace(F.regexp_replace(F.col(col), r"^[<>\s]+|[<>\s]+$", ""), "_+", " "))
    rows = triples.select(F.col(order).alias("ord"), name.alias("entity_name")).filter("entity_name <> ''")
    before = rows.select((F.col("ord") + 1).alias("ord"), F.col("entity_name").alias("last"))
    return rows.join(before, "ord", "left").filter("last is null or last <> entity_name").select("ord", "entity_name")


def wikidata_names(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, aliases and descriptions of items ``id, label, aliases, description``."""
    return items.select("id", "label").filter("label is not null"), items.select("id", F.explode("aliases").alias("alias")), items.select("id", "description").filter("description is not null")


def dictionary_match(chunks: DataFrame, vocabulary: DataFrame, fold: bool = True, max_words: int = 6, id_col: str = "hash_code", text_col: str = "text", word_col: str = "word") -> DataFrame:
    """``source_id, word`` of the vocabulary's words found in each chunk, each once.

    Texts are cut into runs of up to ``max_words`` words, so that the scan is one
    equi-join whatever the vocabulary's size. An entry that is one plain word is
    found by that alone; entries of several words or with other signs are looked
    up by a prefix of ``max_words`` words and verified in the text. Only ASCII
    text is folded, as entries are; a word must not touch a letter or digit.
    """
    low = (lambda c: T.fold_ascii(c)) if fold else (lambda c: F.col(c))
    word_of = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))
    words = vocabulary.select(low(word_col).alias("word")).filter("word <> ''").distinct()
    words = words.withColumn("k", word_of(F.col("word"))).filter(F.size("k") > 0).withColumn("key", F.array_join(F.slice("k", 1, max_words), " "))
    words = words.select("word", "key", ((F.size("k") == 1) & (F.col("word") == F.col("key"))).alias("sure"))
    rows = chunks.select(F.col(id_col).alias("source_id"), low(text_col).alias("t"))
    tokens = rows.select("source_id", word_of(F.col("t")).alias("w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    longer = [runs(n) for n in range(2, max_words + 1)]
    keys = tokens.select("source_id", F.explode(F.array_distinct(F.concat("w", *longer))).alias("key"))
    found = keys.join(broadcast_small(words), "key").select("source_id", "word", "sure").distinct()
    unsure = found.filter("not sure").join(rows, "source_id").filter(T.word_bounded("t", "word"))
    return found.filter("sure").select("source_id", "word").unionByName(unsure.select("source_id", "word")).distinct()


def new_triples(found: DataFrame, known: DataFrame) -> DataFrame:
    """Triples, each once, that aren't known yet (case-blind)."""
    key = lambda: F.lower(F.concat_ws("\t", "head", "relation", "tail"))
    fresh = found.withColumn("__k", key()).dropDuplicates(["__k"])
    return fresh.join(known.select(key().alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def new_frontier(triples: DataFrame, seen: DataFrame) -> DataFrame:
    """Tails that no round has looked at yet."""
    return triples.select(F.lower("tail").alias("entity_name")).distinct().join(seen.select(F.lower("entity_name").alias("entity_name")).distinct(), "entity_name", "left_anti")


def expand_frontier(chunks: DataFrame, seeds: DataFrame, extract: Callable[[DataFrame], DataFrame], rounds: int = 2, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds of match, extract and step to new tails; stops early at an empty frontier.

    ``extract`` maps ``source_id, text, entities`` to triples ``head, relation, tail, source_id``.
    """
    cut = cut or (lambda df: df.checkpoint())
    seen = frontier = seeds.select("entity_name").distinct()
    triples = None
    for _ in range(rounds):
        hits = dictionary_match(chunks, frontier, word_col="entity_name").groupBy("source_id").agg(F.array_sort(F.collect_set("word")).alias("entities"))
        found = extract(hits.join(chunks.select(F.col("hash_code").alias("source_id"), "text"), "source_id"))
        fresh = cut(found.dropDuplicates(["head", "relation", "tail"]) if triples is None else new_triples(found, triples))
        triples = fresh if triples is None else triples.unionByName(fresh)
        frontier = cut(new_frontier(fresh, seen))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return triples, seen


def match_with_segmenter(chunks: DataFrame, words: list[str], boundaries: Callable[[str], set[int]], id_col: str = "hash_code", text_col: str = "text") -> DataFrame:
    """Words of a bounded list in texts without blanks between words: a hit starts or ends at a boundary of the segmenter."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for p in parts:
            rows = []
            for source_id, text in zip(p[id_col], p[text_col].fillna(""), strict=True):
                cuts = boundaries(text)
                rows += {(source_id, w) for end, w in machine.iter(text) if end + 1 in cuts or end + 1 - len(w) in cuts}
            yield pd.DataFrame(rows, columns=["source_id", "word"])

    return chunks.select(id_col, text_col).mapInPandas(run, f"source_id {chunks.schema[id_col].dataType.simpleString()}, word string")


def reference_examples(kg: DataFrame, entities: DataFrame, default: DataFrame) -> DataFrame:
    """Triples of a reference graph whose head is one of the entities (case-blind); the default ones if there are none."""
    wanted = entities.select(F.lower("entity_name").alias("__h")).distinct()
    found = kg.join(wanted, F.lower("head") == F.col("__h"), "left_semi")
    none = found.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return found.unionByName(default.join(F.broadcast(none), F.lit(True), "left_semi"))
