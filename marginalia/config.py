"""Settings: defaults, then a TOML file, then the environment, then explicit values."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path

PREFIX = "MARGINALIA_"
MODES = ("dense", "hybrid", "hybrid-rerank")
TRANSFORMS = ("model-default", "raw", "sigmoid")
_YES, _NO = frozenset({"1", "true", "yes", "on"}), frozenset({"0", "false", "no", "off"})


def as_bool(value: object) -> bool:
    word = str(value).strip().lower()
    if word not in _YES | _NO:
        raise ValueError(f"{value!r} is neither yes nor no")
    return word in _YES


@dataclass(frozen=True)
class IndexConfig:
    """What makes two indexes comparable; its fingerprint is stored with every index."""

    embedding_model: str = "BAAI/bge-small-en-v1.5"
    embedding_revision: str | None = None
    embedding_dimension: int = 384
    normalize_embeddings: bool = True
    chunk_size: int = 300
    chunk_overlap: int = 50
    chunking_strategy: str = "sentence-token"
    context_version: str = "page-paragraph-v1"
    chunking_version: str = "sentence-token-v1"
    text_extraction_version: str = "clean-margins-v2"

    def __post_init__(self) -> None:
        blank = [f.name for f in fields(self) if isinstance(v := getattr(self, f.name), str) and not v.strip()]
        if blank:
            raise ValueError(f"{', '.join(blank)} must not be empty")
        if self.embedding_dimension <= 0 or self.chunk_size <= 0:
            raise ValueError("embedding_dimension and chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be between 0 and chunk_size - 1")
        if self.chunking_strategy != "sentence-token":
            raise ValueError("the only chunking_strategy is 'sentence-token'")

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid-rerank"
    dense_candidates: int = 20
    bm25_candidates: int = 20
    rrf_k: int = 60
    rerank_candidates: int = 20
    final_results: int = 5
    reranker_model: str = "BAAI/bge-reranker-base"
    reranker_score_transform: str = "model-default"
    reranker_min_score: float = 0.01
    max_chunks_per_paper: int = 2
    mmr_lambda: float = 0.75
    paper_cap_policy: str = "baseline"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.reranker_score_transform not in TRANSFORMS:
            raise ValueError(f"reranker_score_transform must be one of {', '.join(TRANSFORMS)}")
        if not self.reranker_model.strip():
            raise ValueError("reranker_model must not be empty")
        for name in ("dense_candidates", "bm25_candidates", "rrf_k", "rerank_candidates", "final_results", "max_chunks_per_paper"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if not math.isfinite(self.reranker_min_score) or not 0 <= self.mmr_lambda <= 1:
            raise ValueError("reranker_min_score must be finite and mmr_lambda between 0 and 1")
        if self.paper_cap_policy not in ("baseline", "task-aware") or (self.paper_cap_policy == "task-aware" and self.mode != "hybrid-rerank"):
            raise ValueError("paper_cap_policy is baseline or, with hybrid-rerank, task-aware")


@dataclass(frozen=True)
class ContextConfig:
    paragraphs: int = 1
    budget_tokens: int = 4000
    window_tokens: int = 8192
    answer_reserve: int = 1024
    expansion_tokens: int = 1500
    framing_reserve: int = 32
    retry_reserve: int = 256
    same_section: bool = True


def _parse(kind: str, value: object) -> object:
    if "bool" in kind:
        return value if isinstance(value, bool) else as_bool(value)
    if kind.startswith("int"):
        return int(value)
    if kind.startswith("float"):
        return float(value)
    return None if value is None or ("None" in kind and not str(value).strip()) else str(value)


def load(cls: type, *, toml: str | Path | None = None, section: str | None = None, environ: Mapping[str, str] | None = None, **given: object) -> object:
    """A config of ``cls``; unknown keys in the file or among explicit values are an error, as are values of another kind."""
    kinds = {f.name: str(f.type) for f in fields(cls)}
    values: dict[str, object] = {}
    if toml is not None:
        data = tomllib.loads(Path(toml).read_text(encoding="utf-8"))
        values |= data.get(section, {}) if section else data
    environ = os.environ if environ is None else environ
    values |= {n: environ[PREFIX + n.upper()] for n in kinds if PREFIX + n.upper() in environ}
    values |= given
    if unknown := sorted(set(values) - set(kinds)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    try:
        return cls(**{n: _parse(kinds[n], v) for n, v in values.items()})
    except TypeError as e:
        raise ValueError(str(e)) from e
