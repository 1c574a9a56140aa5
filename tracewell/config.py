"""Typed settings: defaults, overridden by environment variables TRACEWELL_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    pool: int = 20
    rrf_k: int = 60
    min_score: float = 0.10
    min_hits: int = 1
    min_agreement: float = 0.0
    min_lexical: float = 0.25
    min_coverage: float = 0.30
    chunk_tokens: int = 500
    chunk_overlap: int = 75
    max_evidence: int = 6
    max_block_chars: int = 900
    min_confidence: float = 0.0
    force_first_citation: bool = True
    impact_depth: int = 1
    max_upload_bytes: int = 100 * 1024 * 1024
    llm_provider: str = "extractive"
    llm_url: str = ""
    llm_model: str = ""
    llm_timeout: float = 60.0
    llm_retries: int = 2

    @classmethod
    def load(cls, environ=None) -> Settings:
        """Settings with what the environment overrides; a value of the wrong type is an error."""
        environ = os.environ if environ is None else environ
        given = {}
        for f in fields(cls):
            raw = environ.get(f"TRACEWELL_{f.name.upper()}")
            if raw is not None and raw.strip() != "":
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw.strip())
        return cls(**given)

    def gate(self) -> dict:
        return {k: getattr(self, k) for k in ("min_score", "min_hits", "min_agreement", "min_lexical", "min_coverage")}
