"""Sheets to chunks: a summary parent for each sheet, children of row batches.

A sheet comes as ``rows(doc_id, sheet_idx, sheet_name, row_idx, cells array<string>)``, ``row_idx``
from 0 without the header, and ``heads(doc_id, sheet_idx, sheet_name, columns)``; ``from_grid`` makes
these of a raw grid, ``from_table`` of any DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import folds
from foliospark.functions import text as t
from foliospark.functions import tokens
from foliospark.workspace import materialize

KEY = ["doc_id", "sheet_idx", "sheet_name"]


def is_headerless(first: Column, share: float) -> Column:
    """A first row of which more than ``share`` is numbers is data; an empty row isn't."""
    many = F.coalesce(F.size(first), F.lit(0))
    return F.when(many > 0, F.size(F.filter(first, t.is_numeric)) / many > share).otherwise(F.lit(False))


def from_grid(grid: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``grid(doc_id, sheet_idx, sheet_name, row_idx, cells)`` with the header in row 0 to rows and
    heads; null cells are empty, ragged rows are padded, a blank or missing header is ``col_<i>``."""
    clean = grid.withColumn("cells", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(t.strip(c), F.lit(""))))
    first = F.min_by("cells", "row_idx")
    shape = clean.groupBy(*KEY).agg(first.alias("first"), F.max(F.size("cells")).alias("width"))
    named = lambda c, i: F.when(c == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(c)
    numbered = F.when(F.col("width") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0))), lambda i: F.concat(F.lit("col_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    heads = shape.withColumn("has_header", ~is_headerless(F.col("first"), cfg.headerless_share)).withColumn(
        "columns", F.when(F.col("has_header"), F.transform(t.pad(F.col("first"), F.col("width")), named)).otherwise(numbered)
    )
    rows = clean.join(heads.select(*KEY, "has_header", "width"), KEY).filter(~F.col("has_header") | (F.col("row_idx") > 0))
    rows = rows.select(*KEY, (F.col("row_idx") - F.col("has_header").cast("int")).alias("row_idx"), t.pad(F.col("cells"), F.col("width")).alias("cells"))
    return rows, heads.select(*KEY, "columns", "has_header")


def from_table(df: DataFrame, name: str, order: str, cells: dict[str, Column], doc: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A DataFrame as one sheet, its rows in order of ``order`` (unique); ``cells`` names the columns.

    Rows are numbered without bringing the table into one task: counts of ranges first, then within.
    """
    key = {"doc_id": F.lit(doc or name), "sheet_idx": F.lit(0), "sheet_name": F.lit(name)}
    values = F.array(*[F.coalesce(t.strip(c.cast("string")), F.lit("")) for c in cells.values()])
    ranged = df.select(F.col(order).alias("_o"), values.alias("cells")).repartitionByRange("_o").withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "sheet-ranges")  # both uses below must see the same ranges
    inside = Window.partitionBy("_p").orderBy("_o")
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    rows = ranged.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(offsets.drop("_n")), "_p")
    rows = materialize(rows.withColumns(key).select(*KEY, (F.col("_before") + F.col("_i")).cast("int").alias("row_idx"), "cells"), "sheet-rows")
    # a row of values, not literals, and rows read back: joins on literals would be nested loops
    heads = df.sparkSession.createDataFrame([(doc or name, 0, name, list(cells), True)], "doc_id string, sheet_idx int, sheet_name string, columns array<string>, has_header boolean")
    return rows, heads


def cut(rows: DataFrame, heads: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The only sheet of each ``doc_id`` as sheets of at most ``most`` rows, ``<name>-1``, ``<name>-2``, …"""
    at = F.floor(F.col("row_idx") / most).cast("int")
    parts = rows.select("doc_id", at.alias("sheet_idx"), F.concat_ws("-", "sheet_name", (at + 1).cast("string")).alias("sheet_name"), (F.col("row_idx") % most).alias("row_idx"), "cells")
    return parts, parts.select(*KEY).distinct().join(heads.select("doc_id", "columns", "has_header"), "doc_id")


def dtypes(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``(…, pos, column, dtype)``: empty, int64, float64 or object, by all non-empty cells."""
    cells = rows.select(*KEY, F.posexplode("cells").alias("pos", "cell"))
    seen = F.col("cell") != ""
    kinds = cells.groupBy(*KEY, "pos").agg(
        F.count_if(seen).alias("n"), F.bool_and(~seen | t.is_integer(F.col("cell"))).alias("ints"), F.bool_and(~seen | t.is_numeric(F.col("cell"))).alias("numbers")
    )
    kind = F.when(F.col("n") == 0, "empty").when(F.col("ints"), "int64").when(F.col("numbers"), "float64").otherwise("object")
    named = heads.select(*KEY, F.posexplode("columns").alias("pos", "column"))
    return named.join(kinds, [*KEY, "pos"], "left").select(*KEY, "pos", "column", F.coalesce(kind, F.lit("empty")).alias("dtype"))


def profile(rows: DataFrame, heads: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Per sheet: columns, row_count, whether sparse, whether the row guard holds back its rows."""
    empty = F.size(F.filter("cells", lambda c: c == ""))
    counted = rows.groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("row_count"), F.sum(empty).alias("_empty"), F.sum(F.size("cells")).alias("_all"))
    return (
        heads.join(counted, KEY, "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("sparse_sheet", F.coalesce(F.col("_empty") / F.nullif(F.col("_all"), F.lit(0)) > cfg.sparse_share, F.lit(False)))
        .withColumn("guarded", F.col("row_count") > cfg.max_rows_for_row_chunking)
        .drop("_empty", "_all")
    )


def summaries(rows: DataFrame, heads: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The summary parent of each sheet: ``(…, chunk_id, ordinal, text, token_count, metadata)``."""
    lines = rows.filter(F.col("row_idx") < cfg.sample_rows).join(heads.select(*KEY, "columns"), KEY)
    line = t.serialize_row(F.col("columns"), F.col("cells"))
    sample = lines.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"]).alias("sample"))
    # a repeated column name keeps its first place and its last type
    kinds = dtypes(rows, heads).groupBy(*KEY, "column").agg(F.min("pos").alias("pos"), F.max_by("dtype", "pos").alias("dtype"))
    kinds = kinds.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "column", "dtype"))).alias("kinds"))
    of = profile(rows, heads, cfg).join(sample, KEY, "left").join(kinds, KEY, "left")
    shown = F.array_join(F.transform(F.coalesce("kinds", F.array().cast("array<struct<pos:int,column:string,dtype:string>>")), lambda k: F.concat(k["column"], F.lit("="), k["dtype"])), ", ")
    text = F.array_join(
        F.concat(
            F.array(
                F.concat(F.lit("Sheet: "), F.col("sheet_name")), F.concat(F.lit("Columns: "), F.array_join("columns", ", ")),
                F.concat(F.lit("Rows: "), F.col("row_count").cast("string")), F.concat(F.lit("Dtypes: "), shown),
            ),
            F.when(F.size(F.coalesce("sample", F.array().cast("array<string>"))) > 0, F.concat(F.array(F.lit("Sample:")), F.col("sample"))).otherwise(F.array().cast("array<string>")),
        ),
        "\n",
    )
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_idx")) - 1
    meta = F.to_json(F.struct("row_count", F.size("columns").alias("column_count"), F.when(F.col("sparse_sheet"), True).alias("sparse_sheet"), F.when(F.col("guarded"), "structured_query").alias("routing")))
    path = F.array("sheet_name")
    return of.withColumns({"text": text, "ordinal": ordinal}).select(
        *KEY, t.chunk_id(F.col("doc_id"), path, F.lit("parent"), F.col("ordinal"), F.col("text")).alias("chunk_id"),
        "ordinal", "row_count", "text", t.token_count(F.col("text")).alias("token_count"), meta.alias("metadata"),
    )


def batches(rows: DataFrame, heads: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(…, batch, first_row, last_row, lines)``: rows packed in order, sheets above the guard left out."""
    allowed = profile(rows, heads, cfg).filter(~F.col("guarded")).select(*KEY, "columns")
    line = t.serialize_row(F.col("columns"), F.col("cells"))
    lines = rows.join(allowed, KEY).select(*KEY, "row_idx", line.alias("line"))
    packed = (
        lines.groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("items"))
        .withColumn("sizes", tokens.counts(F.transform("items", lambda x: x["line"])))
        .withColumn("ids", folds.pack_after("sizes", cfg.row_batch_target_tokens, cfg.max_rows_per_chunk))
    )
    each = packed.select(*KEY, F.explode(F.arrays_zip("items", "ids")).alias("z")).select(*KEY, "z.ids", "z.items.row_idx", "z.items.line")
    grouped = each.groupBy(*KEY, F.col("ids").alias("batch")).agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("l"))
    return grouped.select(*KEY, "batch", "first_row", "last_row", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def chunks(rows: DataFrame, heads: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Summary parents and row children: ``(doc_id, chunk_id, parent_id, role, block_type, text,
    section_path, sheet_name, row_range, token_count, metadata, chunk_seq)``."""
    parents = materialize(summaries(rows, heads, cfg), "sheet-parents")
    ordered = Window.partitionBy("doc_id").orderBy("sheet_idx", "batch")
    children = (
        batches(rows, heads, cfg)
        .join(parents.select(*KEY, F.col("chunk_id").alias("parent_id")), KEY)
        .withColumns({"text": F.concat(F.lit("Sheet: "), F.col("sheet_name"), F.lit("\n"), F.col("lines")), "ordinal": F.row_number().over(ordered) - 1})
    )
    path = F.array("sheet_name")
    both = parents.select(
        "doc_id", "sheet_idx", "chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("role"), F.lit(-1).alias("_b"),
        "text", "sheet_name", F.lit(None).cast("array<int>").alias("row_range"), "metadata",
    ).unionByName(children.select(
        "doc_id", "sheet_idx", t.chunk_id(F.col("doc_id"), path, F.lit("child"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "parent_id", F.lit("child").alias("role"),
        F.col("batch").alias("_b"), "text", "sheet_name", F.array("first_row", "last_row").alias("row_range"), F.lit(None).cast("string").alias("metadata"),
    ))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_idx", "_b")) - 1
    return both.select(
        "doc_id", "chunk_id", "parent_id", "role", F.lit("row").alias("block_type"), "text", path.alias("section_path"), "sheet_name", "row_range",
        t.token_count(F.col("text")).alias("token_count"), "metadata", seq.alias("chunk_seq"),
    )
