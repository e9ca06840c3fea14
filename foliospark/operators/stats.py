"""Statistics, warnings and status of documents; flat export; orphan check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The texts of warnings.
DEGRADED = "parent structure degraded to "
GUARDED = "scale guard fired: sheet routed to structured_query"
SPARSE = "sparse sheet detected (pivot/dashboard-like)"
EMPTY_SLIDES = " empty slide(s) skipped"


def sheet_flags(chunks: DataFrame) -> DataFrame:
    """``(doc_id, guarded, sparse_sheet)`` of documents that have chunks, as their metadata says."""
    said = lambda path, value: F.coalesce(F.get_json_object("metadata", path) == value, F.lit(False))
    return chunks.groupBy("doc_id").agg(F.bool_or(said("$.routing", "structured_query")).alias("guarded"), F.bool_or(said("$.sparse_sheet", "true")).alias("sparse_sheet"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, parents, children, tokens, and counts by block type as sorted JSON."""
    kinds = chunks.groupBy("doc_id", "block_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "parent").alias("p"), F.count_if(F.col("role") == "child").alias("c"), F.sum("token_count").alias("t")
    )  # groups of few rows each; the second step moves one row a document and block type
    by = F.transform(F.array_sort(F.collect_list(F.struct("block_type", "n"))), lambda x: F.concat(F.lit('"'), x["block_type"], F.lit('":'), x["n"].cast("string")))
    return kinds.groupBy("doc_id").agg(
        F.sum("n").alias("chunk_count"), F.sum("p").alias("parent_count"), F.sum("c").alias("child_count"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"),
        F.concat(F.lit("{"), F.array_join(by, ","), F.lit("}")).alias("counts_by_block_type"),
    )


def warnings(strategy: Column, guarded: Column, sparse: Column, empty_slides: Column) -> Column:
    """What a reader should know, in a fixed order."""
    return F.array_compact(F.array(
        F.when(strategy.isin("PAGE", "FLAT"), F.concat(F.lit(DEGRADED), strategy)),
        F.when(guarded, F.lit(GUARDED)),
        F.when(sparse, F.lit(SPARSE)),
        F.when(F.coalesce(empty_slides, F.lit(0)) > 0, F.concat(empty_slides.cast("string"), F.lit(EMPTY_SLIDES))),
    ))


def status(error: Column, said: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(F.size(said) > 0, "partial").otherwise("success")


def results(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document with counts, warnings and status; a failed one has its error as its only
    warning. ``docs`` may have ``guarded`` and ``sparse_sheet``."""
    for extra in ("guarded", "sparse_sheet"):
        if extra not in docs.columns:
            docs = docs.withColumn(extra, F.lit(False))
    said = warnings(F.col("parent_strategy"), F.col("guarded"), F.col("sparse_sheet"), F.col("empty_slides"))
    joined = docs.join(doc_stats(chunks), "doc_id", "left").withColumn("warnings", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(said))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("chunk_count", "parent_count", "child_count", "total_tokens")}
    return joined.withColumns(zero | {"status": status(F.col("error"), F.when(F.col("error").isNull(), F.col("warnings")).otherwise(F.array().cast("array<string>")))}).select(
        "doc_id", "source_uri", "file_type", "status", "error", "parent_strategy", "empty_slides", *zero, F.coalesce("counts_by_block_type", F.lit("{}")).alias("counts_by_block_type"), "warnings"
    )


def report(of: DataFrame) -> DataFrame:
    """``results`` as an overview, by file type and address."""
    return of.select("file_type", "source_uri", "status", "parent_count", "child_count", "total_tokens", "parent_strategy", F.array_join("warnings", "; ").alias("warnings")).orderBy("file_type", "source_uri")


def orphans(chunks: DataFrame) -> DataFrame:
    """Children whose parent isn't there."""
    children = chunks.filter("role = 'child'")
    parents = chunks.filter("role = 'parent'").select(F.col("chunk_id").alias("parent_id")).distinct()
    return children.join(parents, "parent_id", "left_anti").select("chunk_id", "doc_id", "parent_id")


def flat_export(chunks: DataFrame) -> DataFrame:
    """Chunks as a page of text with flat metadata: paths joined, row ranges in two columns, and the
    entries of the JSON object ``metadata`` as ``extra``, values as text."""
    entries = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    flat = F.array_sort(F.transform(F.map_entries(F.coalesce(entries, F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return chunks.select(
        F.col("text").alias("page_content"), "chunk_id", "doc_id", "parent_id", "role", "block_type", F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ").alias("section_path"),
        "source_uri", "file_type", "page", "slide_number", "sheet_name", F.get("row_range", F.lit(0)).alias("row_start"), F.get("row_range", F.lit(1)).alias("row_end"), "token_count",
        F.array_join(flat, ";").alias("extra"),
    )


def flat_json(chunks: DataFrame) -> DataFrame:
    """The flat export as one JSON object a chunk, absent values left out; entries of ``metadata``
    replace core keys of the same name."""
    core = F.from_json(F.to_json(F.struct(*[c for c in flat_export(chunks).columns if c not in ("page_content", "extra")])), "map<string,string>")
    given = flat_export(chunks).join(chunks.select("chunk_id", "metadata").dropDuplicates(["chunk_id"]), "chunk_id").withColumn("core", core)
    extra = F.coalesce(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter("core", lambda k, v: ~F.map_contains_key(F.col("_x"), k))
    return given.withColumn("_x", extra).select("page_content", F.to_json(F.map_concat(kept, F.col("_x"))).alias("metadata"))
