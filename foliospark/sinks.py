"""Writing chunks and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(chunks: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a chunk, nulls written, in UTF-8; ``by`` names folders, whose files replace
    those of earlier runs."""
    writer = chunks.write.mode("overwrite").option("ignoreNullFields", "false")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def read_jsonl(spark: SparkSession, path: str, schema, offset: int = 0, limit: int | None = None, doc_id: str | None = None) -> tuple[DataFrame, int]:  # type: ignore[no-untyped-def]
    """A page of written chunks in order of document and place, and how many there are."""
    rows = spark.read.schema(schema).json(path)
    if doc_id is not None:
        rows = rows.filter(F.col("doc_id") == doc_id)
    page = rows.orderBy("doc_id", "chunk_seq").offset(offset)
    return (page if limit is None else page.limit(limit)), rows.count()
