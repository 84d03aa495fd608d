"""Scores of predictions and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions import text as T

METRICS = ("answer_score", "exact_match", "token_f1", "numeric_match", "list_f1", "page_hit", "page_precision", "page_recall", "page_f1")


def match_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with their gold row: by document and question id, else by document and question text; unmatched ones stay."""
    g = gold.select(F.col("doc_id").alias("__d"), F.col("question_id").alias("__q"), F.col("question").alias("__t"), F.struct("*").alias("gold"))
    by_id = predictions.join(g.drop("__t"), (F.col("doc_id") == F.col("__d")) & (F.col("question_id") == F.col("__q")), "left").drop("__d", "__q")
    missing = by_id.filter("gold is null").drop("gold")
    first = g.groupBy("__d", "__t").agg(F.min_by("gold", "__q").alias("gold"))
    by_text = missing.join(first, (F.col("doc_id") == F.col("__d")) & (F.col("question") == F.col("__t")), "left").drop("__d", "__t")
    return by_id.filter("gold is not null").unionByName(by_text)


def page_scores(gold: Column, found: Column) -> list[Column]:
    """``page_hit, page_precision, page_recall, page_f1``; null without gold pages."""
    g, p = F.array_distinct(gold), F.array_distinct(found)
    both = F.size(F.array_intersect(g, p))
    known = F.size(g) > 0
    precision = F.when(F.size(p) > 0, both / F.size(p)).otherwise(0.0)
    recall = both / F.size(g)
    f1 = F.when(both > 0, 2.0 * both / (F.size(g) + F.size(p))).otherwise(0.0)
    return [F.when(known, (both > 0).cast("double")).alias("page_hit"), F.when(known, precision).alias("page_precision"), F.when(known, recall).alias("page_recall"), F.when(known, f1).alias("page_f1")]


def evidence_pages(*groups: Column | str, widest: int = 20) -> Column:
    """Pages that evidence names, ranges of at most ``widest`` pages filled in; sorted."""
    def pages(x: Column) -> Column:
        ends = F.filter(F.array(x["page"], x["page_start"], x["page_end"]), lambda p: p.isNotNull())
        wide = (x["page_start"] > 0) & (x["page_end"] >= x["page_start"]) & (x["page_end"] - x["page_start"] <= widest)
        return F.array_union(ends, F.when(wide, F.sequence(x["page_start"], F.greatest(x["page_start"], x["page_end"]))).otherwise(F.array().cast("array<int>")))

    all_of = F.concat(*[F.coalesce(F.col(g) if isinstance(g, str) else g, F.array().cast("array<struct<page:int,page_start:int,page_end:int>>")) for g in groups])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(all_of, pages))))


def score_rows(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Every prediction with its metrics."""
    rows = match_gold(predictions, gold)
    meta = F.col("gold.metadata")
    field = lambda k: T.clean_scalar(F.try_element_at(meta, F.lit(k)))
    rows = rows.select(
        "doc_id", "question_id", "question", F.coalesce(F.col("gold.answer"), F.col("gold_answer")).alias("gold_answer"), "prediction", F.coalesce(field("answer_format"), F.lit("Unknown")).alias("answer_format"),
        F.coalesce(field("doc_type"), F.lit("Unknown")).alias("doc_type"), F.filter(F.transform(T.parse_list(F.coalesce(F.try_element_at(meta, F.lit("evidence_pages")), F.lit(""))), lambda x: x.try_cast("int")), lambda x: x.isNotNull()).alias("evidence_pages"),
        T.parse_list(F.coalesce(F.try_element_at(meta, F.lit("evidence_sources")), F.lit(""))).alias("evidence_sources"), evidence_pages("text_evidence", "visual_evidence", "table_evidence").alias("retrieved_pages"), "trace_error",
    )
    return rows.select("*", *T.answer_scores("gold_answer", "prediction", "answer_format"), *page_scores(F.col("evidence_pages"), F.col("retrieved_pages")))


def means(rows: DataFrame, *by: Column, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Count, means that skip nulls, and the share of rows with an error."""
    out = [F.count(F.lit(1)).alias("count"), *[F.avg(m).alias(m) for m in metrics]]
    if "trace_error" in rows.columns:
        out.append(F.avg(F.col("trace_error").isNotNull().cast("double")).alias("missing_workspace_rate"))
    return rows.groupBy(*by).agg(*out)


def grouped_means(rows: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return means(rows, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("Unknown")).alias(key), metrics=metrics)


def multivalue_means(rows: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by each value of an array column; a row counts under every value it has, under None if it has none."""
    values = F.when(F.size(key) > 0, F.col(key)).otherwise(F.array(F.lit(None).cast("string")))
    exploded = rows.withColumn("__v", F.explode(values))
    return means(exploded, F.coalesce(F.nullif("__v", F.lit("")), F.lit("None")).alias(key), metrics=metrics)


def report(rows: DataFrame) -> DataFrame:
    """All groupings in one table ``grouping, key``: overall, by answer format, by document type and by evidence source."""
    parts = [means(rows).withColumn("key", F.lit("all")).withColumn("grouping", F.lit("overall"))]
    for name, how in (("answer_format", grouped_means), ("doc_type", grouped_means), ("evidence_sources", multivalue_means)):
        parts.append(how(rows, name).withColumnRenamed(name, "key").withColumn("grouping", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def valid_mean(rows: DataFrame, col: str = "score", invalid: float = -1.0) -> DataFrame:
    """Mean of valid scores, and how many are valid or not."""
    ok = F.col(col) != invalid
    return rows.agg(F.avg(F.when(ok, F.col(col))).alias("mean"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def reason_counts(rows: DataFrame, col: str = "reasons") -> DataFrame:
    """Reasons by number, most first; what follows an equals sign in an error is left out."""
    reason = F.regexp_replace("reason", r"^(\w*error)=.*$", "$1")
    return rows.select(F.explode(col).alias("reason")).select(reason.alias("reason")).groupBy("reason").count().orderBy(F.desc("count"), "reason")


def split_work(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents with a finished workspace, and those without."""
    keys = done.select(key).distinct()
    return docs.join(keys, key, "left_semi"), docs.join(keys, key, "left_anti")


def pending(docs: DataFrame, manifest: DataFrame, force: bool = False, skip_graph: bool = False) -> DataFrame:
    """Documents that still have to be built."""
    if force:
        return docs
    done = manifest if skip_graph else manifest.filter("graph_status = 'built'")
    return split_work(docs, done)[1]


def build_status(docs: DataFrame, artifacts: DataFrame, wanted: list[str]) -> DataFrame:
    """Stage and missing artifacts of each document; ``artifacts`` is ``doc_id, name``."""
    have = artifacts.groupBy("doc_id").agg(F.collect_set("name").alias("have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("have", F.array().cast("array<string>"))))
    rows = docs.select("doc_id").distinct().join(have, "doc_id", "left").withColumn("missing", missing)
    return rows.select("doc_id", "missing", F.when(F.size("missing") == 0, "built").when(F.size("missing") == len(wanted), "absent").otherwise("partial").alias("status"))


def token_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Number of model calls and sums of their prompt and completion tokens; null counts as none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), total("prompt_tokens"), total("completion_tokens"))


def zip_rows(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of two tables side by side by their ordinals, to the shorter's end."""
    return left.join(right, order, "inner")


def packed_widths(triples: DataFrame, col: str = "triple") -> DataFrame:
    """How many packed rows have six fields, and how many have not."""
    six = F.size(F.split(col, "\t")) == 6
    return triples.agg(F.count_if(six).alias("with_description"), F.count_if(~six).alias("without"))


def triple_sources(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """Triples with the paragraph they come from, by page and paragraph."""
    return triples.join(sources, ["page_idx", "paragraph_idx"], "inner")


def recent_documents(rows: DataFrame, k: int = 8) -> DataFrame:
    """Active documents first, then built ones, latest first."""
    rank = F.when(F.col("status") == "active", 0).otherwise(1)
    return rows.orderBy(rank, F.desc("modified"), "doc_id").limit(k)


def first_queries(rows: DataFrame, domain: str, order: str = "ord") -> DataFrame:
    """The queries that are judged: 130 of the mixed domain, 100 of others."""
    return rows.orderBy(order).limit(130 if domain == "mix" else 100)


def stage_counts(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows by each value of each column, in one table ``what, value, count``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in cols]))
    return rows.select(pairs.alias("p")).groupBy("p.what", "p.value").count()
