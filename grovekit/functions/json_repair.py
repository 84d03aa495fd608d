"""JSON out of model answers, mended where it is broken (Arrow batches)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = re.compile(r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|\{[^{}]*\}|[^,}\s]+)')
_FENCED = re.compile(r"(`{3,})(?:json)?\s*(.*?)\1", re.S)


def first_object(text: str) -> str | None:
    """The first balanced pair of braces, braces in strings counted too."""
    depth, start = 0, -1
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                return text[start : m.end()].replace("\n", "")
    return None


def fenced(text: str) -> str | None:
    """What stands between code fences, if anything does."""
    m = _FENCED.search(text)
    return m[2].strip() if m else None


def loose_pairs(text: str) -> dict[str, str]:
    """Key and value texts of a broken object; nested objects give their own pairs as well."""
    out: dict[str, str] = {}
    for key, value in _PAIR.findall(text):
        out[key] = value[1:-1] if value[:1] == '"' else value
        if value[:1] == "{":
            out.update(loose_pairs(value))
    return out


def repaired(text: str | None) -> dict[str, str]:
    """Top-level fields as text: parsed if the first object is sound, picked out if not."""
    found = first_object(text or "")
    if found:
        try:
            return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in json.loads(found).items()}
        except ValueError:
            pass
    return loose_pairs(text or "")


def json_fields(c: Column | str) -> Column:
    """``map<string,string>`` of the fields of the object in an answer; empty if there is none."""

    @F.pandas_udf("map<string,string>")
    def fields(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return fields(c)


def community_fields(c: Column | str, fallback_name: Column, fallback_description: Column) -> list[Column]:
    """Name, description and findings of a community report, by whatever keys the answer used; blanks fall back."""
    m = json_fields(c)
    pick = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys])
    findings = F.coalesce(F.from_json(pick("findings"), "array<struct<summary:string,explanation:string>>"), F.array().cast("array<struct<summary:string,explanation:string>>"))
    return [
        F.coalesce(pick("entity_name", "name", "title"), fallback_name).alias("entity_name"),
        F.coalesce(pick("entity_description", "description", "summary"), fallback_description).alias("entity_description"),
        findings.alias("findings"),
    ]
