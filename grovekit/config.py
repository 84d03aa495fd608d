"""Settings of a workspace; every field can be given by an environment variable ``GROVE_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1024
    chunk_overlap: int = 128
    cluster_size: int = 20
    top_k: int = 10
    evidence_k: int = 5
    level_mode: int = 0  # 0 base nodes, 1 aggregates, 2 all
    lca_mode: str = "aligned"  # or "level"
    relation_token_unit: int = 40
    summary_tokens: int = 50
    media_per_chunk: int = 3
    media_per_entity: int = 5
    frontier_rounds: int = 2
    fold_case: bool = True

    @classmethod
    def from_env(cls, **given) -> Settings:
        for f in fields(cls):
            raw = os.environ.get(f"GROVE_{f.name.upper()}")
            if raw is not None and f.name not in given:
                kind = type(f.default)
                given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**given)
