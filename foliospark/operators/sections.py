"""Elements to sections: heading stack, pages, short-page carry, flat text and slides.

``elements(doc_id, seq, kind, text, page, end_page, level, is_page_start, table_rows,
table_markdown, caption)`` in order of ``seq``. Builders give ``sections`` and the ``blocks`` and
``tables`` in them, keyed by ``(doc_id, sec_idx)``. Documents of any size are cut into stretches (see ``order``), and folds into
what can't depend on anything before: the headings under one of the highest level, the pages up to
one that isn't short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import folds
from foliospark.functions import text as t
from foliospark.operators.order import numbered as number_in_order
from foliospark.operators.order import running_sum
from foliospark.workspace import materialize


@dataclass(frozen=True)
class Parts:
    """``sections``, and their ``blocks`` and ``tables``."""

    sections: DataFrame
    blocks: DataFrame
    tables: DataFrame


def _no_path() -> Column:
    return F.array().cast("array<string>")


def with_ids(sections: DataFrame, blocks: DataFrame, tables: DataFrame, table_no: Column | None = None) -> Parts:
    """Give sections, blocks and tables their identifiers."""
    sec = F.concat_ws("-sec-", "doc_id", "sec_idx")
    order = F.row_number().over(Window.partitionBy("doc_id", "sec_idx").orderBy("seq")) - 1
    numbered = tables.withColumn("tbl_seq", table_no) if table_no is not None else number_in_order(tables, ["doc_id"], "sec_idx", ["sec_idx", "seq"], "tbl_seq")
    return Parts(
        sections.withColumn("section_id", sec),
        blocks.withColumn("block_order", order).withColumn("block_id", F.concat(sec, F.lit("-b"), F.col("block_order").cast("string"))),
        numbered.withColumn("table_id", F.concat(F.col("doc_id"), F.lit("-tbl-"), F.col("tbl_seq").cast("string"))),
    )


def _split(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = placed.filter((F.col("kind") != "table") & ~t.is_blank(F.col("text")))
    blocks = texts.select("doc_id", "sec_idx", "seq", t.strip(F.col("text")).alias("text"), "page")
    tables = placed.filter(F.col("kind") == "table").select("doc_id", "sec_idx", "seq", F.col("table_markdown").alias("markdown"), F.col("table_rows").alias("rows"), "caption", "page")
    return blocks, tables


def _pages(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "sec_idx").agg(F.min_by("page", "seq").alias("page_start"), F.max_by("page", F.when(F.col("page").isNotNull(), F.col("seq"))).alias("page_end"))


def heading_paths(given: DataFrame) -> DataFrame:
    """``given(doc_id, sec_idx, l, x)``, headings in order, to ``(doc_id, sec_idx, heading, level,
    section_path)``. A heading of a document's highest level ends all others, so the fold starts anew
    there and takes in what is under one such heading."""
    top = given.groupBy("doc_id").agg(F.min("l").alias("_top"))
    named = given.select("doc_id", "sec_idx", "l", t.strip(F.col("x")).alias("x")).join(top, "doc_id")
    under = running_sum(named, ["doc_id"], "sec_idx", ["sec_idx"], (F.col("l") == F.col("_top")).cast("int"), "_under")
    return (
        under.groupBy("doc_id", "_under")
        .agg(F.array_sort(F.collect_list(F.struct("sec_idx", "l", "x"))).alias("h"))
        .withColumn("lx", F.transform("h", lambda h: F.struct(h["l"].alias("l"), h["x"].alias("x"))))
        .withColumn("paths", folds.heading_paths("lx"))
        .select("doc_id", F.explode(F.arrays_zip("h", "paths")).alias("z"))
        .select("doc_id", "z.h.sec_idx", F.col("z.h.x").alias("heading"), F.col("z.h.l").alias("level"), F.col("z.paths").alias("section_path"))
    )


def by_headings(elements: DataFrame) -> Parts:
    """A section for each heading, its path the headings above it; text before the first heading is a
    root section of level 0, left out if empty while others exist. A heading's text is no block."""
    is_head = F.col("kind") == "heading"
    placed = running_sum(elements, ["doc_id"], "seq", ["seq"], is_head.cast("int"), "sec_idx")
    level = F.coalesce("level", F.lit(1))
    heads = heading_paths(placed.filter(is_head).select("doc_id", "sec_idx", level.alias("l"), F.coalesce("text", F.lit("")).alias("x")))
    blocks, tables = _split(placed.filter(~is_head))
    used = blocks.select("doc_id", "sec_idx").unionByName(tables.select("doc_id", "sec_idx")).filter("sec_idx = 0").distinct()
    bare = elements.groupBy("doc_id").agg(F.bool_or(is_head).alias("any")).filter("not any").select("doc_id", F.lit(0).alias("sec_idx"))
    roots = used.unionByName(bare).distinct().select("doc_id", "sec_idx", F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), _no_path().alias("section_path"))
    sections = heads.unionByName(roots).join(_pages(blocks), ["doc_id", "sec_idx"], "left")
    return with_ids(sections, blocks, tables)


def by_pages(elements: DataFrame, cfg: Settings = Settings()) -> Parts:
    """A section for each page, headings kept as text; text over several pages is in each of them.

    A page of fewer than ``min_child_tokens`` and no table is carried into the next; the section
    keeps the last page's path. Blocks stay in reading order over merged pages, or with
    ``interleave_merged_pages`` take turns: the first of each page, the second of each page, ….
    """
    first = F.coalesce("page", F.lit(1))
    spread = elements.withColumn("page", F.explode(F.sequence(first, F.greatest(first, F.coalesce("end_page", first)))))
    texts, tables = _split(spread.withColumn("sec_idx", F.lit(0)).withColumn("kind", F.when(F.col("kind") == "heading", "text").otherwise(F.col("kind"))))
    per = texts.groupBy("doc_id", "page").agg(F.sum(t.token_count(F.col("text"))).cast("bigint").alias("n")).join(
        tables.groupBy("doc_id", "page").agg(F.lit(True).alias("tb")), ["doc_id", "page"], "full"
    )
    per = per.select("doc_id", "page", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("tb", F.lit(False)).alias("tb"))
    per = materialize(per, "pages")  # a row a page; what follows reads it several times
    # a page that isn't short ends its section whatever came before: the carry starts anew behind it
    closing = ((F.col("n") >= cfg.min_child_tokens) | F.col("tb")).cast("int")
    runs = running_sum(per, ["doc_id"], "page", ["page"], closing, "_run").withColumn("_run", F.col("_run") - closing)
    folded = (
        runs.groupBy("doc_id", "_run")
        .agg(F.array_sort(F.collect_list(F.struct("page", "n", "tb"))).alias("p"))
        .withColumn("items", F.transform("p", lambda p: F.struct(p["n"].alias("n"), p["tb"].alias("tb"))))
        .withColumn("ids", folds.carry_short("items", cfg.min_child_tokens))
        .select("doc_id", F.explode(F.arrays_zip("p", "ids")).alias("z"), "_run")
        .select("doc_id", "z.p.page", "_run", F.col("z.ids").alias("_g"))
    )
    starts = folded.groupBy("doc_id", "_run", "_g").agg(F.min("page").alias("_page"))
    starts = number_in_order(starts, ["doc_id"], "_page", ["_page"], "sec_idx").drop("_page")
    merged = materialize(folded.join(starts, ["doc_id", "_run", "_g"]).select("doc_id", "page", "sec_idx"), "merged-pages")
    sections = merged.groupBy("doc_id", "sec_idx").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    sections = sections.select(
        "doc_id", "sec_idx", F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"),
        F.array(F.concat(F.lit("Page "), F.col("page_end").cast("string"))).alias("section_path"), "page_start", "page_end",
    )
    reading = F.row_number().over(Window.partitionBy("doc_id", "sec_idx").orderBy("page", "seq"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "sec_idx").orderBy("_turn", "page", "seq"))
    here = lambda df: df.drop("sec_idx").join(merged, ["doc_id", "page"]).withColumn("seq", reading)
    if cfg.interleave_merged_pages:
        turns = texts.withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))
        blocks = turns.drop("sec_idx").join(merged, ["doc_id", "page"]).withColumn("seq", turn).drop("_turn")
    else:
        blocks = here(texts)
    count = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_s"))
    placed = number_in_order(here(tables), ["doc_id"], "sec_idx", ["sec_idx", "seq"], "_t").join(count, "doc_id")
    parts = with_ids(sections, blocks, placed, (F.col("_s") * 1000 + F.col("_t")).cast("int"))
    return Parts(parts.sections, parts.blocks, parts.tables.drop("_s", "_t"))


def flat(elements: DataFrame) -> Parts:
    """One section with everything in it and an empty path."""
    placed = elements.withColumn("sec_idx", F.lit(0))
    blocks, tables = _split(placed)
    docs = elements.select("doc_id").distinct()
    sections = docs.select("doc_id", F.lit(0).alias("sec_idx"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), _no_path().alias("section_path"))
    return with_ids(sections.join(_pages(blocks), ["doc_id", "sec_idx"], "left"), blocks, tables)


def by_slides(elements: DataFrame, docs: DataFrame) -> Parts:
    """A section for each slide from 1 to the larger of ``docs.num_slides`` and the last page. The
    title is the first heading, else the first text; a heading equal to it is left out of the body."""
    placed = elements.withColumn("sec_idx", F.coalesce("page", F.lit(1)) - 1)
    last = placed.groupBy("doc_id").agg((F.max("sec_idx") + 1).alias("_last"))
    slides = docs.select("doc_id", "num_slides").join(last, "doc_id", "left").withColumn("_n", F.greatest(F.coalesce("num_slides", F.lit(0)), F.coalesce("_last", F.lit(0))))
    slides = slides.filter("_n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("sec_idx"))
    said = (F.col("kind") != "table") & ~t.is_blank(F.col("text"))
    rank = F.when(said & (F.col("kind") == "heading"), F.struct(F.lit(0), F.col("seq"))).when(said, F.struct(F.lit(1), F.col("seq")))
    titles = placed.groupBy("doc_id", "sec_idx").agg(F.min_by(t.strip(F.col("text")), rank).alias("heading"))
    sections = slides.join(titles, ["doc_id", "sec_idx"], "left").select(
        "doc_id", "sec_idx", "heading", F.lit(1).alias("level"),
        F.array(F.coalesce("heading", F.concat(F.lit("Slide "), (F.col("sec_idx") + 1).cast("string")))).alias("section_path"),
        (F.col("sec_idx") + 1).alias("page_start"), (F.col("sec_idx") + 1).alias("page_end"),
    )
    body = placed.join(titles, ["doc_id", "sec_idx"], "left").filter(~((F.col("kind") == "heading") & (t.strip(F.coalesce("text", F.lit(""))) == F.coalesce("heading", F.lit("")))))
    blocks, tables = _split(body)
    number = (F.col("sec_idx") + 1) * 1000 + F.row_number().over(Window.partitionBy("doc_id", "sec_idx").orderBy("seq")) - 1
    return with_ids(sections, blocks, tables, number)
