"""Documents to chunks and layout items to chunks and media."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text as T
from grovekit.sources.checkpoints import cut


def char_windows(docs: DataFrame, size: int = 1024, overlap: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_index, start, hash_code, text`` of sliding windows of characters; ids hash the raw window."""
    step = size - overlap
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col(text_col), s + 1, F.lit(size)).alias("raw")))  # cut first: rows carry their own window alone
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("chunk_index", "c"))
    raw = F.col("c.raw")
    return rows.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.md5(raw.cast("binary")).alias("hash_code"), T.strip(F.replace(raw, F.lit("\n"), F.lit(""))).alias("text"))


def word_windows(docs: DataFrame, size: int = 256, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = T.tokens, joiner: str = " ") -> DataFrame:
    """The same with windows of tokens; ``tokenizer`` maps a text to an array of strings, by default its words. An empty text has no tokens."""
    step = size - overlap
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.length(text_col) > 0, tokenizer(F.col(text_col))).alias("__w"))
    starts = F.when(F.size("__w") > 0, F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step)))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("__w", s + 1, size), joiner).alias("text")))
    out = rows.select("doc_id", F.posexplode(parts).alias("chunk_index", "c"))
    return out.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.md5(F.col("c.text").cast("binary")).alias("hash_code"), F.col("c.text").alias("text"))


def split_long(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True) -> DataFrame:
    """Whole texts of at most ``size`` characters as one chunk, longer ones as windows, each stripped."""
    step = max(1, size - overlap)
    text = T.strip(text_col)
    windows = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda s: T.strip(F.substring(text, s + 1, F.lit(size))))
    parts = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(windows)
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("chunk_index", "text"))
    return out.filter(F.length("text") > 0) if drop_empty else out


def flatten_items(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Items of ``pages[].items`` with the page's number where the item has none, in order (``ord``)."""
    outer = pages.select(F.col(id_col).alias("doc_id"), F.posexplode("pages").alias("page_ord", "pg"))
    inner = outer.select("doc_id", "page_ord", F.col("pg.page_no").alias("page_no"), F.posexplode_outer("pg.items").alias("item_ord", "item"))
    rows = inner.filter(F.col("item").isNotNull()).select("doc_id", F.coalesce(F.col("item.page_idx"), F.col("page_no")).alias("page"), "page_ord", "item_ord", "item")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord", "item_ord")) - 1).drop("page_ord", "item_ord")


def carry_sections(items: DataFrame, part: str, order: list[str], is_heading: Column, title: Column) -> DataFrame:
    """``section_title`` of each row: the latest heading so far."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section_title", F.last(F.when(is_heading, F.substring(title, 1, 200)), ignorenulls=True).over(w))


def number_rows(items: DataFrame, part: str, order: list[str], name: str, prefix: str) -> DataFrame:
    """A running number from 0 in each part and an id ``<part><prefix>NNNNNN``."""
    n = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return items.withColumn(name, n).withColumn(f"{name}_id", F.format_string("%s" + prefix + "%06d", F.col(part).cast("string"), F.col(name)))


def layout_chunks(items: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Text chunks of layout items ``doc_id, ord, type, text, page, bbox``: typed, sectioned, split and numbered."""
    text = items.filter(T.item_type("type") == "text").withColumn("text", T.strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    text = carry_sections(text, "doc_id", ["ord"], T.looks_like_heading("text"), F.col("text"))
    parts = split_long(text.withColumn("__k", F.struct("doc_id", "ord", "page", "bbox", "section_title")), size, overlap, "__k").select(F.col("doc_id").alias("__k"), "chunk_index", "text").select("__k.*", "chunk_index", "text")
    out = number_rows(parts, "doc_id", ["ord", "chunk_index"], "text_order", "_chunk_")
    return out.select(F.col("text_order_id").alias("chunk_id"), T.content_id("doc_id", "text_order", "text").alias("hash_code"), "doc_id", "text", F.lit("text").alias("modality"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "section_title", "bbox", F.col("text_order").alias("order"))


def layout_media(items: DataFrame, asset_root: str = "") -> DataFrame:
    """Images and tables of layout items, numbered, with a path and a summary."""
    rows = items.withColumn("modality", T.item_type("type")).filter("modality <> 'text'")
    rows = number_rows(rows, "doc_id", ["ord"], "media_order", "_media_")
    path = F.when(F.col("path").startswith("/") | F.lit(not asset_root), F.col("path")).otherwise(F.concat_ws("/", F.lit(asset_root), F.col("path")))
    summary = T.media_summary(F.col("modality"), F.col("caption"), F.col("text"), F.col("table_body"), F.col("footnote"))
    return rows.select(F.concat_ws("_", F.col("doc_id").cast("string"), "modality", F.lpad(F.col("media_order").cast("string"), 6, "0")).alias("media_id"), "doc_id", "modality", "page", F.coalesce(path, F.lit("")).alias("path"), "caption", F.col("text").alias("ocr_text"), summary.alias("summary"), "bbox", F.col("media_order"))


def budget_prefix(rows: DataFrame, part: list[str], order: list[Column | str], cost: Column, cap: int) -> DataFrame:
    """The longest prefix of each part whose running cost is at most ``cap``."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= cap)


def first_documents(rows: DataFrame, n: int, id_col: str = "doc_id", order: str = "ord") -> DataFrame:
    """All rows of the first ``n`` distinct documents."""
    first = rows.groupBy(id_col).agg(F.min(order).alias("__first")).orderBy("__first", id_col).limit(n).select(id_col)
    return rows.join(F.broadcast(first), id_col, "left_semi")


def ordinals(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """A gapless number from 0 in global order: range partitions are numbered each, then moved by the counts before them."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    split = dealt.withColumn("__p", F.shiftrightunsigned("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = split.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__off")
    return split.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__off") + F.col("__i")).alias(name))


def question_contexts(rows: DataFrame) -> DataFrame:
    """Contexts of the rows that ask something."""
    return rows.filter(F.col("input").isNotNull()).select("context")
