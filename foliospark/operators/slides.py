"""Slides to chunks: children of slides, parents of the slides around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import text as t
from foliospark.operators import prose
from foliospark.workspace import materialize

Splitter = prose.Splitter


def with_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """The blocks of slides with the slides' tables, captions and grids, where they stand among them."""
    grid = F.coalesce(F.nullif(F.col("markdown"), F.lit("")), t.grid_to_markdown(F.col("rows")))
    order = F.row_number().over(Window.partitionBy("doc_id", "sec_idx").orderBy("seq")) - 1
    columns = ("doc_id", "sec_idx", "seq", "block_id", "text", "page")
    shown = tables.select("doc_id", "sec_idx", "seq", F.col("table_id").alias("block_id"), t.table_text(F.col("caption"), grid).alias("text"), "page")
    return blocks.select(*columns).unionByName(shown).withColumn("block_order", order)


def slides(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(doc_id, sec_idx, heading, section_path, slide_number, text, divider, empty)``."""
    kept = blocks.filter(~t.is_blank(F.col("text"))).groupBy("doc_id", "sec_idx").agg(F.array_sort(F.collect_list(F.struct("block_order", "seq", "text"))).alias("b"))
    joined = sections.join(kept.select("doc_id", "sec_idx", F.transform("b", lambda x: x["text"]).alias("body")), ["doc_id", "sec_idx"], "left")
    headed = ~t.is_blank(F.col("heading"))
    body = F.coalesce("body", F.array().cast("array<string>"))
    lines = F.when(headed, F.concat(F.array("heading"), body)).otherwise(body)
    return joined.select(
        "doc_id", "sec_idx", "heading", "section_path", F.col("page_start").alias("slide_number"), F.array_join(lines, "\n").alias("text"),
        (headed & (F.size(body) == 0)).alias("divider"), (~headed & (F.size(body) == 0)).alias("empty"),
    )


def windows(of: DataFrame, width: int = 1) -> DataFrame:
    """Non-empty slides with ``i`` (from 0), ``window`` (the texts within ``width`` of it) and
    ``group`` (the latest divider, slides before the first counting with slide 0)."""
    order = Window.partitionBy("doc_id").orderBy("sec_idx")
    kept = of.filter(~F.col("empty")).withColumn("i", F.row_number().over(order) - 1)
    near = order.rowsBetween(-width, width)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumns({
        "window": F.array_join(F.collect_list("text").over(near), "\n\n"),
        "group": F.coalesce(F.max(F.when(F.col("divider") & (F.col("i") > 0), F.col("i"))).over(upto), F.lit(0)),
        "sectioned": F.bool_or("divider").over(Window.partitionBy("doc_id")),
    })


def parent_texts(of: DataFrame) -> DataFrame:
    """``(doc_id, i, parent_text)``: a slide's section where its deck has dividers, else its window."""
    groups = of.filter("sectioned").groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("s"))
    groups = groups.select("doc_id", "group", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("all"))
    return of.join(groups, ["doc_id", "group"], "left").select("doc_id", "i", F.when(F.col("sectioned"), F.col("all")).otherwise(F.col("window")).alias("parent_text"))


def parents(texts: DataFrame) -> DataFrame:
    """Equal texts of a document are one parent, numbered by where they come first:
    ``(doc_id, ordinal, chunk_id, text)``."""
    firsts = texts.groupBy("doc_id", F.sha2("parent_text", 256).alias("h")).agg(F.min("i").alias("i"), F.min_by("parent_text", "i").alias("text"))
    numbered = firsts.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1)
    return numbered.withColumn("chunk_id", t.chunk_id(F.col("doc_id"), F.array(F.lit("slide-window")), F.lit("parent"), F.col("ordinal"), F.col("text")))


def chunks(sections: DataFrame, blocks: DataFrame, splitter: Splitter = prose.by_size, cfg: Settings = Settings()) -> DataFrame:
    """Parents and children of decks: ``(doc_id, chunk_id, parent_id, role, block_type, text,
    section_path, slide_number, token_count, chunk_seq)``. A slide above ``max_child_tokens`` is split
    by ``splitter`` only, so pieces may stay above it."""
    deck = materialize(windows(slides(sections, blocks), cfg.slide_window), "slide-windows")
    texts = parent_texts(deck)
    up = parents(texts)
    link = texts.withColumn("h", F.sha2("parent_text", 256)).join(up.select("doc_id", "h", F.col("chunk_id").alias("parent_id")), ["doc_id", "h"]).select("doc_id", "i", "parent_id")
    large = F.col("token_count") > cfg.max_child_tokens
    named = deck.withColumns({"token_count": t.token_count(F.col("text")), "parent_key": F.concat_ws("\u001f", "doc_id", "i")})
    cut = splitter(named.filter(large).select(F.col("parent_key").alias("parent_id"), "text", "token_count"), cfg).select(F.col("parent_id").alias("parent_key"), "at", "text")
    keep = named.select("parent_key", "doc_id", "i", "section_path", "slide_number")
    each = named.filter(~large).select("parent_key", F.lit(0).alias("at"), "text").unionByName(cut).join(keep, "parent_key").join(link, ["doc_id", "i"])
    down = each.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "at")) - 1)
    null = F.lit(None).cast("string")
    children = down.select(
        "doc_id", t.chunk_id(F.col("doc_id"), F.col("section_path"), F.lit("child"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "parent_id", F.lit("child").alias("role"),
        "text", "section_path", "slide_number", F.lit(1).alias("_r"), "ordinal",
    )
    ups = up.select("doc_id", "chunk_id", null.alias("parent_id"), F.lit("parent").alias("role"), "text", F.array(F.lit("slide-window")).alias("section_path"), F.lit(None).cast("int").alias("slide_number"), F.lit(0).alias("_r"), "ordinal")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("_r", "ordinal")) - 1
    return ups.unionByName(children).withColumns({"block_type": F.lit("slide"), "token_count": t.token_count(F.col("text")), "chunk_seq": seq}).drop("_r", "ordinal")
