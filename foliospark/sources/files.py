"""Files to documents, elements and grids, in parallel by file; a bad file is a row with an error."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.sources.decoders import REGISTRY, Registry

ELEMENT = "doc_id string, seq int, kind string, text string, page int, end_page int, level int, is_page_start boolean, table_rows array<array<string>>, table_markdown string, caption string"
_DECODED = (
    "source_uri string, mtime string, file_type string, title string, page_count int, num_slides int, error string, "
    "elements array<struct<seq:int,kind:string,text:string,page:int,end_page:int,level:int,is_page_start:boolean,table_rows:array<array<string>>,table_markdown:string,caption:string>>, "
    "sheets array<struct<sheet_idx:int,sheet_name:string,rows:array<array<string>>>>"
)


def scan(spark: SparkSession, folder: str, registry: Registry = REGISTRY, glob: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of the supported files below ``folder``. The
    extension is tested on the path, before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*sorted(registry.extensions())))


def canonical_uri(path: str) -> str:
    """The file's address as ``file:///…``, percent-encoded."""
    if "://" in path and not path.startswith("file:"):
        return path
    local = unquote(urlparse(path).path) if path.startswith("file:") else path
    return Path(os.path.abspath(local)).as_uri()


def decode(files: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """One row a file with its elements and sheets, or with the error that its decoder raised. Its identifier
    is made of its address and the time of change that the scan found, wherever it is decoded."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(_DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for f in batch.to_pylist():
                name = unquote(f["path"].rsplit("/", 1)[-1])
                kind = name.rsplit(".", 1)[-1].lower()
                row = {"source_uri": canonical_uri(f["path"]), "mtime": repr(f["modificationTime"].timestamp()), "file_type": kind, "elements": [], "sheets": []}
                try:
                    found = registry.find(kind)(bytes(f["content"]), name)
                    row |= {"title": found.title or name.rsplit(".", 1)[0], "page_count": found.page_count, "num_slides": found.num_slides}
                    row["elements"] = [{"is_page_start": False} | e | {"seq": k} for k, e in enumerate(found.elements)]
                    row["sheets"] = [{"sheet_idx": k, "sheet_name": s, "rows": rows} for k, (s, rows) in enumerate(found.sheets)]
                except Exception as e:  # noqa: BLE001 - a bad file must not fail its batch
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in arrow.names}], schema=arrow)

    return files.select("path", "modificationTime", "content").mapInArrow(run, schema).withColumn("doc_id", t.doc_id(F.col("source_uri"), F.col("mtime")))


def documents(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "source_uri", "file_type", "title", "page_count", "num_slides", "error")


def elements(decoded: DataFrame) -> DataFrame:
    return with_page_starts(decoded.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*"))


def grids(decoded: DataFrame) -> DataFrame:
    """``(doc_id, sheet_idx, sheet_name, row_idx, cells)``."""
    sheets = decoded.select("doc_id", F.explode("sheets").alias("s"))
    return sheets.select("doc_id", "s.sheet_idx", "s.sheet_name", F.posexplode("s.rows").alias("row_idx", "cells"))


def with_page_starts(items: DataFrame) -> DataFrame:
    """``is_page_start`` on the first text of each page; a text made a heading uses up its page's
    start without being one."""
    first = _is_first(items, F.col("kind") == "text")
    return first.withColumn("is_page_start", F.coalesce("is_page_start", F.lit(False)) | F.col("_is_first")).select(*items.columns)


def _is_first(items: DataFrame, among: Column) -> DataFrame:
    """``items`` with ``_is_first``: the first of its page that ``among`` holds for. By partial minima, so a
    document without pages isn't gathered."""
    firsts = items.filter(among & F.col("page").isNotNull()).groupBy("doc_id", "page").agg(F.min("seq").alias("_first"))
    return items.join(firsts, ["doc_id", "page"], "left").withColumn("_is_first", among & F.coalesce(F.col("seq") == F.col("_first"), F.lit(False)))


def classify(label: Column, kind: Column) -> Column:
    """The kind of a raw item: ``table``, ``section_header`` and ``text`` items; a label with
    "picture" is dropped (null), one with header, title or section is a heading."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(kind == "table", "table")
        .when(kind == "section_header", "heading")
        .when(low.contains("picture"), F.lit(None).cast("string"))
        .when(low.rlike("header|title|section"), "heading")
        .otherwise("text")
    )


def normalize(items: DataFrame) -> DataFrame:
    """``items(doc_id, seq, item, label, text, page, level, …)`` from a layout model to elements;
    headings have level 1 unless they say otherwise."""
    named = items.withColumn("kind", classify(F.col("label"), F.col("item"))).filter("kind is not null")
    # every text item that isn't a picture uses its page's start up, headings by label included
    firsts = _is_first(named, F.col("item") == "text").select(*named.columns, "_is_first")
    level = F.when(F.col("kind") == "heading", F.when(F.col("item") == "section_header", F.coalesce("level", F.lit(1))).otherwise(1))
    return firsts.withColumns({"is_page_start": F.col("_is_first") & (F.col("kind") == "text"), "level": level}).drop("item", "label", "_is_first")
