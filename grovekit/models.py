"""Model hooks: language, embedding and vision models are callables; stubs make every build deterministic."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextModel(Protocol):
    def __call__(self, prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class VisionModel(Protocol):
    def __call__(self, query: str, context: str, images: list[str]) -> str: ...


def silent_model(prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> str:
    """The model that never answers: builds fall back to names and descriptions of their own."""
    return ""


class HashEmbedder:
    """Unit vectors from hashed words; equal texts have equal vectors."""

    def __init__(self, dim: int = 64, max_words: int = 4096):
        self.dim, self.max_words = dim, max_words

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split()[: self.max_words]:
                h = hashlib.md5(w.encode()).digest()
                row[int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] & 1 else -1
            n = float(np.linalg.norm(row))
            if n:
                row /= n
        return out


class Retrying:
    """Call a model up to ``attempts`` times; an empty answer where all fail."""

    def __init__(self, model: Callable[..., str], attempts: int = 5, wait: float = 0.0):
        self.model, self.attempts, self.wait = model, attempts, wait

    def __call__(self, *args, **kwargs) -> str:
        for i in range(self.attempts):
            try:
                return self.model(*args, **kwargs)
            except Exception:
                if i + 1 < self.attempts and self.wait:
                    time.sleep(self.wait * 2**i)
        return ""


class RoundRobin:
    """Deal calls over several endpoints of one model."""

    def __init__(self, models: list[Callable[..., str]]):
        self.models, self.turn = models, 0

    def __call__(self, *args, **kwargs) -> str:
        model = self.models[self.turn % len(self.models)]
        self.turn += 1
        return model(*args, **kwargs)


def glean(model: TextModel, prompt: str, follow_up: str, rounds: int = 1) -> str:
    """An answer and up to ``rounds`` continuations, in one text."""
    answer = model(prompt)
    history = pack_history(prompt, answer)
    for _ in range(rounds):
        more = model(follow_up, history=history)
        if not more:
            break
        answer += more
        history += pack_history(follow_up, more)
    return answer


def pack_history(*turns: str) -> list[dict]:
    """Turns in the roles of user and assistant by turns."""
    return [{"role": "assistant" if i % 2 else "user", "content": t} for i, t in enumerate(turns)]


def image_url(data: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64," + base64.b64encode(data).decode()


def default_captioner(path: str) -> str:
    return f"Image evidence from {path}"


def default_table_summary(text: str) -> str:
    return " ".join((text or "").split())[:1000]


def parse_judgement(answer: str) -> dict[str, dict]:
    """A judge's scores by criterion, from JSON that may stand between fences; empty where there is none."""
    a, z = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[a : z + 1]) if 0 <= a < z else {}
    except ValueError:
        return {}
    return {k: v for k, v in found.items() if isinstance(v, dict)}


def embed(df: DataFrame, embedder: Embedder, text_col: str = "description", out_col: str = "embedding", batch: int = 64) -> DataFrame:
    """Add a vector to each row, in Arrow batches dealt to the model ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [r for at in range(0, len(texts), batch) for r in np.asarray(embedder(texts[at : at + batch]), np.float32)]
            yield pd.Series(rows, index=s.index)

    return df.withColumn(out_col, vectors(text_col))


def generate(df: DataFrame, model: TextModel, prompt_col: str, out_col: str = "answer") -> DataFrame:
    """Add a model's answer to each row's prompt; failures are empty."""
    safe = Retrying(model, attempts=1)

    @F.pandas_udf("string")
    def answers(prompts: pd.Series) -> pd.Series:
        return prompts.fillna("").map(safe)

    return df.withColumn(out_col, answers(prompt_col))


def ask(model: TextModel, prompt: Column) -> Column:
    """The model's answer to each prompt, in Arrow batches; null where the prompt is null or the model is silent or fails."""
    safe = Retrying(model, attempts=1)

    @F.pandas_udf("string")
    def answers(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: (safe(p) or None) if p is not None else None)

    return answers(prompt)


def verify_entities(names: DataFrame, model: TextModel, batch: int = 100) -> DataFrame:
    """``entity_name``: the distinct lines of the model's answers to lists of at most about ``batch`` names each."""
    n = -(-names.count() // batch)
    lists = names.select("entity_name").distinct().groupBy(F.pmod(F.xxhash64("entity_name"), F.lit(max(n, 1))).alias("i")).agg(F.array_join(F.array_sort(F.collect_list("entity_name")), "\n").alias("names"))
    head, tail = PROMPTS["verify"].split("{names}")
    said = lists.select(ask(model, F.concat(F.lit(head), "names", F.lit(tail))).alias("a"))
    return said.select(F.explode(F.split("a", "\n")).alias("a")).select(F.trim("a").alias("entity_name")).filter("entity_name <> ''").distinct()


class Limited:
    """At most ``most`` calls of a model at once in one process."""

    def __init__(self, model: Callable[..., str], most: int = 8):
        self.model, self.most, self._gate = model, most, None

    def __call__(self, *args, **kwargs) -> str:
        if self._gate is None:
            self._gate = threading.BoundedSemaphore(self.most)
        with self._gate:
            return self.model(*args, **kwargs)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_gate": None}


class HttpChat:
    """A chat model behind the usual JSON interface. The key is read where the model runs: from the given variables in turn, else as given."""

    def __init__(self, url: str, model: str, key_names: tuple[str, ...] = ("GROVE_API_KEY",), key: str = "", most_chars: int = 200_000, timeout: float = 120):
        self.url, self.model, self.key_names, self.key, self.most_chars, self.timeout = url, model, key_names, key, most_chars, timeout

    def request(self, prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> dict:
        said = [{"role": "system", "content": system_prompt}] if system_prompt else []
        return {"model": self.model, "messages": [*said, *(history or []), {"role": "user", "content": prompt[: self.most_chars]}]}

    def __call__(self, prompt: str, system_prompt: str | None = None, history: list[dict] | None = None) -> str:
        key = next((os.environ[k] for k in self.key_names if os.environ.get(k)), self.key)
        body = json.dumps(self.request(prompt, system_prompt, history)).encode()
        call = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(call, timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"] or ""


def fill_media(media: DataFrame, captioner: Callable[[str], str] = default_captioner, table_model: Callable[[str], str] = default_table_summary, overwrite: bool = False) -> DataFrame:
    """Caption images and summarise tables that have none (or all, with ``overwrite``)."""
    caption = F.pandas_udf(lambda s: s.fillna("").map(captioner), "string")
    summary = F.pandas_udf(lambda s: s.fillna("").map(table_model), "string")
    blank = lambda c: F.lit(overwrite) | (F.coalesce(F.col(c), F.lit("")) == "")
    body = F.coalesce(F.nullif("table_markdown", F.lit("")), F.col("table_html"))
    return media.withColumn("caption", F.when((F.col("modality") == "image") & blank("caption"), caption("path")).otherwise(F.col("caption"))).withColumn(
        "summary", F.when((F.col("modality") == "table") & blank("summary"), summary(body)).otherwise(F.col("summary"))
    )


# Prompts of our own; every one is filled with str.format.
PROMPTS = {
    "extract": "List the entities and relations in the text. Write each as a record.\nText: {text}",
    "continue": "Some records are missing. Add them in the same form.",
    "describe_triple": "Describe subject, relation and object of {triple} in JSON, by this text: {text}",
    "summarize_entity": "Merge these descriptions of {name} into one paragraph:\n{description}",
    "aggregate": "Name and describe what these entities have in common, as JSON with findings:\n{members}",
    "relate": "Describe how {a} and {b} are related, in at most {tokens} tokens:\n{relations}",
    "answer": "Answer by the context alone.\nContext:\n{context}\nQuestion: {question}",
    "verify": "Keep of this list what names a thing or an idea, one per line and as it is written.\n{names}",
    "judge": "Score the answer from 1 to 10 for each criterion, as JSON.\nQuestion: {question}\nAnswer: {answer}",
    "judge_triple": "Score from 0 to 1 how well the text supports the triple, as JSON with score and rationale.\nText: {text}\nTriple: {triple}",
}
