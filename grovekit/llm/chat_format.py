"""Chat formatting by multi-party perspective rotation, with DataFrame operations only.

A conversation with k participants is rendered k times. In each rendering one
participant speaks as the assistant and is what a model learns from; the others
are users who carry their names. The result is kept as rendered segments (a
turn of a perspective), so that a conversation of any length needs no task
that holds it whole; segments in order of ``turn, segment_key`` make up the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system", "tool")  # seen by all, never a perspective and never learnt from
NOBODY = "unknown"  # speaker of turns without one
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per perspective and turn of ``conv_id, turn, role, text``.

    ``perspective``; ``chat_role`` (assistant, user or the context role); ``name``
    of a user; ``segment``, the rendered text; ``mask_start`` and ``mask_end``, the
    code points of the segment that are learnt from (equal for other speakers);
    ``n_chars``; ``segment_key``, which orders turns of the same number by speaker
    and text. Null text is empty; a null role is the speaker ``unknown``; a null
    ``conv_id`` is a conversation of its own; repeated turns appear each; a
    conversation of context roles alone has no perspective and no rows.
    """
    speaker = F.coalesce(F.col("role"), F.lit(NOBODY))
    rows = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("content"))
    context = F.col("speaker").isin(*context_roles)
    people = rows.filter(~context).groupBy(F.col("conv_id").alias("__conv")).agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "turn", "speaker", "content", F.explode("people").alias("perspective"))
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(context, F.col("speaker")).when(mine, "assistant").otherwise("user")
    name = F.when(~context & ~mine, F.col("speaker"))
    out = seen.select("conv_id", "perspective", "turn", "content", role.alias("chat_role"), name.alias("name"), F.md5(F.concat_ws("|", "speaker", "content").cast("binary")).alias("segment_key"))
    head = F.concat(F.lit(OPEN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit(CLOSE))
    segment = F.concat(head, F.col("content"), F.lit(END))
    learnt = F.col("chat_role") == "assistant"
    start = F.length(head).cast("long")
    full = F.length(segment).cast("long")
    return out.select(
        "conv_id", "perspective", "turn", "segment_key", "chat_role", "name", segment.alias("segment"), F.when(learnt, start).otherwise(F.lit(0)).alias("mask_start"), F.when(learnt, full).otherwise(F.lit(0)).alias("mask_end"), full.alias("n_chars")
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('system', 'tool')),
r AS (
  SELECT t.conv_id, perspective, turn, content, md5(speaker || '|' || content) AS segment_key,
         CASE WHEN speaker IN ('system', 'tool') THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
         CASE WHEN speaker NOT IN ('system', 'tool') AND speaker <> perspective THEN speaker END AS name
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, segment_key, chat_role, name, head || content || '<|end|>' || chr(10) AS segment,
       CASE WHEN chat_role = 'assistant' THEN length(head) ELSE 0 END::BIGINT AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN length(head || content) + 8 ELSE 0 END::BIGINT AS mask_end,
       (length(head || content) + 8)::BIGINT AS n_chars
FROM h
"""
