"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.functions.tokens import encoding

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SLICE = 200_000


def count(encoder, text: str | None) -> int:  # type: ignore[no-untyped-def]
    """Tokens of a text; null and empty ones have 0. Very long texts are counted line by line run."""
    if not text:
        return 0
    if len(text) <= _SLICE:
        return len(encoder.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):  # a cut between a word and the space before the next changes no token
        end = start + _SLICE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(encoder.encode_ordinary(text[start:end]))
        start = end
    return total


def with_tokens(df: DataFrame, text: str, out: str, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` without its column ``text``, with the column ``out``: tokens of it, as int.

    The vocabulary file is one of the driver's; executors get it with the job.
    """
    df.sparkSession.sparkContext.addFile(ranks_file)
    name = os.path.basename(ranks_file)
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(SparkFiles.get(name))
        for batch in batches:
            sizes = pa.array([count(encoder, t) for t in batch.column(text).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sizes], names=[*kept, out])

    return df.mapInArrow(run, schema)
