"""Models by configuration: embedders and the classifier of headings.

Libraries are imported where they are needed, on the driver to see that they are there and in the
workers to run; one that is missing is an ImportError that names it. Models are loaded once in each
worker, and offline settings are put in force there before.
"""

from __future__ import annotations

import importlib
import json
import urllib.request
from collections.abc import Callable
from functools import lru_cache

from foliospark.config import Settings, enforce_offline, provider_kind

# Fixed value: the version of the hosted service's interface.
HOSTED_API = "2024-06-01"


def _need(library: str) -> None:
    importlib.import_module(library)


@lru_cache(maxsize=2)
def _local_model(name: str, device: str, offline: bool):  # type: ignore[no-untyped-def]
    if offline:
        enforce_offline()
    return importlib.import_module("sentence_transformers").SentenceTransformer(name, device=device)


def _hosted(cfg: Settings):  # type: ignore[no-untyped-def]
    return importlib.import_module("openai").AzureOpenAI(azure_endpoint=cfg.azure_openai_endpoint, api_key=cfg.azure_openai_api_key, api_version=HOSTED_API)


def _check_hosted(cfg: Settings) -> None:
    if not cfg.azure_openai_endpoint or not cfg.azure_openai_api_key:
        raise ValueError("a hosted provider needs azure_openai_endpoint and azure_openai_api_key")
    _need("openai")


def vectors(cfg: Settings) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """What loads the model of ``cfg.embedding_provider`` in a worker."""
    kind = provider_kind(cfg.embedding_provider)
    if kind == "local":
        _need("sentence_transformers")

        def local() -> Callable[[list[str]], list[list[float]]]:
            model = _local_model(cfg.local_embedding_model, cfg.local_embedding_device, cfg.offline)
            return lambda texts: model.encode(texts, batch_size=cfg.embedding_batch_size, normalize_embeddings=True).tolist()

        return local
    if kind == "hosted":
        _check_hosted(cfg)

        def hosted() -> Callable[[list[str]], list[list[float]]]:
            client = _hosted(cfg)
            return lambda texts: [x.embedding for x in client.embeddings.create(model=cfg.embedding_deployment, input=texts).data]

        return hosted
    raise ValueError(f"no embedder registered for {cfg.embedding_provider!r}")


def answers(cfg: Settings) -> Callable[[str], str]:
    """From prompt to answer by the model of ``cfg.llm_provider``: a local server, or a hosted model."""
    kind = cfg.llm_provider.lower()
    if kind == "ollama":
        url, model = cfg.ollama_base_url.rstrip("/") + "/api/generate", cfg.ollama_model

        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0}}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=300) as said:  # noqa: S310
                return json.loads(said.read())["response"]

        return ask
    if provider_kind(kind) == "hosted":
        _check_hosted(cfg)

        def ask_hosted(prompt: str) -> str:
            said = _hosted(cfg).chat.completions.create(model=cfg.toc_inference_deployment, temperature=0, messages=[{"role": "user", "content": prompt}])
            return said.choices[0].message.content

        return ask_hosted
    raise ValueError(f"unknown provider of a language model: {cfg.llm_provider!r}")
