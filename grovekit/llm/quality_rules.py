"""Quality rules with host-level verdicts.

Each text is measured once (one Arrow pass, no shuffle). Rule failures are
summed by host, every rule's failure rate of a host is shrunk towards an
empirical beta prior fitted over all hosts by the method of moments, and a host
whose shrunk rate is over a limit takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import cut, slices, text_bytes, trim

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10  # of the characters in words
MAX_DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 100_000  # host verdicts are broadcast up to this many rows
RULES = ("short", "repeats", "symbols", "dup_lines")
_SYMBOLS = b"#*$%&|<>"
_MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for x in windows:
        (twice if x in seen else seen).add(x)
    total = end = 0
    for at, x in enumerate(windows):
        if x in twice:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one UTF-8 text, in the order of ``_MEASURES``."""
    words = text.split()  # white space of bytes is \x20 and \x09-\x0D
    solid = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), len(solid.decode()), len(solid) - len(solid.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measure_documents(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns with the measures of each text; null text has no words."""
    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [_MEASURES])
    names = kept.columns + [x.split()[0] for x in _MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in slices(batches):
            found = [measure(t) for t in text_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"), *keep).mapInArrow(run, schema)


def _failed(rule: str) -> Column:
    c = F.col
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"),
    }[rule]


def host_verdicts(measured: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``host, n_docs, host_rate, host_failed``: the largest shrunk failure rate over the rules.

    The prior of a rule has the pooled rate as mean and a weight of
    ``mean * (1 - mean) / variance - 1``, kept within 1 and 10,000, where the
    variance is that of the hosts' raw rates.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(_failed(r).cast("long")).alias(r) for r in RULES])
    hosts = cut(hosts)
    prior = hosts.agg(*[x for r in RULES for x in ((F.sum(r) / F.sum("n_docs")).alias(f"{r}_mean"), F.var_pop(F.col(r) / F.col("n_docs")).alias(f"{r}_var"))]).first().asDict()
    rates = []
    for r in RULES:
        mean, var = prior[f"{r}_mean"] or 0.0, prior[f"{r}_var"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, 1.0), 10_000.0) if var > 0 else 10_000.0
        rates.append((F.col(r) + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))
    return hosts.select("host", "n_docs", F.greatest(*rates).alias("host_rate")).withColumn("host_failed", F.col("host_rate") > limit)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its id, measures, ``base_failed``, the host's rate and ``kept``.

    Null text counts as empty and fails the base rule; a null host is a host of
    its own; repeated rows are judged each; an empty table gives no rows.
    Columns beyond the three named are ignored, whatever they are called.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    measured = cut(measure_documents(plain, "text", "doc_id", "source"))
    hosts = host_verdicts(measured, "source", limit)
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("base_failed", _failed("short") | _failed("repeats")).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop("host", "n_docs")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines
  FROM w),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g),
p AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY doc_id),
x AS (SELECT m.*, coalesce(p.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
f AS (
  SELECT *, (n_words < 50)::BIGINT AS f1, (100 * n_repeat_words > 50 * n_words)::BIGINT AS f2,
         (100 * n_symbols > 10 * word_chars)::BIGINT AS f3, (100 * n_dup_lines > 30 * n_lines)::BIGINT AS f4 FROM x),
h AS (SELECT source, count(*) AS n, unnest([sum(f1), sum(f2), sum(f3), sum(f4)]) AS bad, unnest([1, 2, 3, 4]) AS rule FROM f GROUP BY source),
q AS (SELECT rule, sum(bad) / sum(n) AS mean, var_pop(bad / n) AS v FROM h GROUP BY rule),
z AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1), 10000) ELSE 10000 END AS wt FROM q),
y AS (SELECT source, max((bad + mean * wt) / (n + wt)) AS host_rate FROM h JOIN z USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 + f2 > 0) AS base_failed,
       (f1 + f2 = 0 AND NOT host_rate > 0.5) AS kept
FROM f JOIN y ON f.source IS NOT DISTINCT FROM y.source
"""
