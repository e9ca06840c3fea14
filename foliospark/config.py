"""Settings, as frozen values that plans take as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass, fields

HOSTED = ("azure_openai", "azure")
LOCAL = ("sentence_transformers", "local", "st")


def provider_kind(name: str) -> str:
    """``hosted``, ``local`` or ``other``, whatever its case."""
    return "hosted" if name.lower() in HOSTED else "local" if name.lower() in LOCAL else "other"


@dataclass(frozen=True)
class Settings:
    """How files become chunks. ``from_env`` reads ``FOLIO_<NAME>`` and ignores unknown names."""

    embedding_provider: str = "sentence_transformers"
    embedding_batch_size: int = 64
    local_embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    local_embedding_device: str = "cpu"
    azure_openai_endpoint: str | None = None
    azure_openai_api_key: str | None = None
    embedding_deployment: str = "text-embedding-3-large"
    breakpoint_threshold_type: str = "percentile"
    breakpoint_threshold_amount: float = 95.0
    max_parent_tokens: int = 3000
    max_child_tokens: int = 800
    min_child_tokens: int = 100
    row_batch_target_tokens: int = 400
    max_rows_per_chunk: int = 10
    max_rows_for_row_chunking: int = 5000
    slide_window: int = 1
    min_headings_for_structure: int = 2
    min_heading_page_coverage: float = 0.6
    enable_llm_toc_inference: bool = False
    max_heading_candidates: int = 500
    max_heading_chars: int = 120
    llm_provider: str = "ollama"
    ollama_model: str = "mistral"
    ollama_base_url: str = "http://localhost:11434"
    toc_inference_deployment: str = "gpt-4o-mini"
    token_counter: str = "whitespace"
    token_encoder_model: str | None = None
    min_chars_per_page: int = 50
    enable_embedding_cache: bool = True
    cache_dir: str = ".ingest_cache"
    offline: bool = False
    # thresholds of sheets and ways of merging
    headerless_share: float = 0.5
    sparse_share: float = 0.4
    sample_rows: int = 3
    interleave_merged_pages: bool = False
    emit_slide_tables: bool = False

    def __post_init__(self) -> None:
        hosted = [name for name in ("embedding_provider", "llm_provider") if provider_kind(getattr(self, name)) == "hosted"]
        if self.offline and hosted:
            raise ValueError(f"offline: {', '.join(hosted)} would send text off-machine")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "FOLIO_") -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = str(f.type)
            if kind.startswith("bool"):
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif kind.startswith("int"):
                given[f.name] = int(raw)
            elif kind.startswith("float"):
                given[f.name] = float(raw)
            else:
                given[f.name] = raw
        return cls(**given)


# What keeps model libraries from reaching for a network.
OFFLINE_ENVIRONMENT = {
    "HF_HUB_OFFLINE": "1", "TRANSFORMERS_OFFLINE": "1", "HF_HUB_DISABLE_TELEMETRY": "1", "HF_HUB_DISABLE_IMPLICIT_TOKEN": "1",
    "LANGCHAIN_TRACING_V2": "false", "LANGCHAIN_TRACING": "false", "ANONYMIZED_TELEMETRY": "False",
}


def enforce_offline(env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Put a process offline; what its environment already sets is kept. Returns what was set."""
    env = os.environ if env is None else env
    missing = {k: v for k, v in OFFLINE_ENVIRONMENT.items() if k not in env}
    env.update(missing)
    return missing


def offline_conf(existing: Mapping[str, str]) -> dict[str, str]:
    """Session settings that put executors offline; what ``existing`` already sets is kept."""
    return {k: v for name, v in OFFLINE_ENVIRONMENT.items() if (k := f"spark.executorEnv.{name}") not in existing}
