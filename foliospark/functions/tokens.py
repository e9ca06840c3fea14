"""Token counters: words natively, or a public vocabulary through an Arrow UDF.

``configure`` chooses the counter that plans built afterwards use, as one setting of the process;
``using`` does so for a while. Packers add up the sizes of what they join, which is exact for words;
for vocabularies a join may differ by a token or two where pieces meet.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.config import LOCAL, Settings

#: Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_active: tuple[str, str | None] = ("whitespace", None)


def backend(cfg: Settings) -> tuple[str, str | None]:
    """The counter a configuration means: ``whitespace``, ``tiktoken`` or ``hf`` and its vocabulary
    file; ``auto`` is ``hf`` offline or with a local embedder, else ``tiktoken``."""
    name = cfg.token_counter
    if name == "auto":
        name = "hf" if cfg.offline or cfg.embedding_provider in LOCAL else "tiktoken"
    if name not in ("whitespace", "tiktoken", "hf"):
        raise ValueError(f"unknown token counter: {name!r}")
    if name != "whitespace" and not cfg.token_encoder_model:
        raise ValueError(f"{name} needs a vocabulary file (token_encoder_model)")
    return name, cfg.token_encoder_model


def configure(cfg: Settings) -> None:
    global _active
    _active = backend(cfg)


@contextmanager
def using(cfg: Settings) -> Iterator[None]:
    global _active
    before, _active = _active, backend(cfg)
    try:
        yield
    finally:
        _active = before


@lru_cache(maxsize=4)
def encoding(ranks_file: str):  # type: ignore[no-untyped-def]
    """A byte-level BPE from a ranks file; read once in each worker."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("folio", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def counter(name: str, file: str | None) -> Callable[[str], int]:
    """The counter in Python; a vocabulary is read once in each worker."""
    if name == "whitespace":
        return lambda s: len(s.split())
    if name == "tiktoken":
        encoder = encoding(str(file))
        return lambda s: len(encoder.encode_ordinary(s))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(file))
    return lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)


def is_native() -> bool:
    return _active[0] == "whitespace"


def active() -> tuple[str, str | None]:
    return _active


def count(text: Column) -> Column:
    """Tokens of a text; null and empty ones have 0."""
    if is_native():
        return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    name, file = _active

    @F.pandas_udf("int")
    def run(s):  # type: ignore[no-untyped-def]
        of = counter(name, file)
        return s.map(lambda x: of(x) if x else 0).astype("int32")

    return run(text)


def counts(texts: Column) -> Column:
    """Tokens of each text of an array, as bigint."""
    if is_native():
        return F.transform(texts, lambda x: count(x).cast("bigint"))
    name, file = _active

    @F.pandas_udf("array<bigint>")
    def run(s):  # type: ignore[no-untyped-def]
        of = counter(name, file)
        return s.map(lambda a: None if a is None else [of(x) if x else 0 for x in a])

    return run(texts)
