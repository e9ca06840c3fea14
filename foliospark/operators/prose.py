"""Sections to prose chunks: parents of packed paragraphs, children split by meaning and size, and
table children under them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import folds
from foliospark.functions import text as t
from foliospark.functions import tokens
from foliospark.operators.order import numbered
from foliospark.workspace import materialize

Splitter = Callable[[DataFrame, Settings], DataFrame]


def section_texts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, sec_idx, text)``: blocks in order, joined by blank lines, blank ones left out."""
    kept = blocks.filter(~t.is_blank(F.col("text")))
    block = F.struct("block_order", "seq", "text")
    joined = kept.groupBy("doc_id", "sec_idx").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return joined.select("doc_id", "sec_idx", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def paragraph_parts(texts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``texts(doc_id, sec_idx, text)`` to ``(…, part, parts, text)``: paragraphs packed up to
    ``max_parent_tokens``; a paragraph is never split, however large."""
    split = texts.withColumn("paras", F.filter(F.split("text", "\n\n"), lambda p: ~t.is_blank(p))).filter(F.size("paras") > 0)
    packed = split.withColumn("sizes", tokens.counts(F.col("paras"))).withColumn("starts", folds.starts_before("sizes", cfg.max_parent_tokens))
    texts = F.transform(folds.cut(F.col("paras"), F.col("starts")), lambda part: F.array_join(part, "\n\n"))
    return packed.select("doc_id", "sec_idx", F.size("starts").alias("parts"), F.posexplode(texts).alias("part", "text")).select("doc_id", "sec_idx", "part", "parts", "text")


def sentences(text: Column) -> Column:
    """Split behind ``.``, ``?`` or ``!`` and white space."""
    return F.split(text, r"(?<=[.?!])\s+")


def merge_pieces(pieces: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``pieces(keys…, at, text)`` to the same with small neighbours merged by line breaks, blank
    pieces left out, ``at`` renumbered."""
    kept = pieces.filter(~t.is_blank(F.col("text"))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    sized = kept.withColumn("sizes", tokens.counts(F.transform("p", lambda x: x["text"]))).withColumn("ids", folds.merge_small("sizes", least))
    each = sized.select(*keys, F.explode(F.arrays_zip("p", "ids")).alias("z")).select(*keys, F.col("z.ids").alias("g"), "z.p.at", "z.p.text")
    merged = each.groupBy(*keys, F.col("g").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"))
    return merged.select(*keys, "at", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def recursive_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` tokens: at blank lines, lines, then blanks; neighbours are packed
    again while they fit. Text within the limit is one piece.

    The native counter is additive, so each level is a fold over sizes, and a piece that still is too
    large goes on to the next separator; other counters do the same in Python.
    """
    if not tokens.is_native():
        return _recursive_udf(text, limit)

    def at(parts: Column, glue: str) -> Column:
        empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).cast("bigint").alias("n"))

        def step(a: Column, p: Column) -> Column:
            size = t.token_count(p).cast("bigint")
            fits = (a["n"] > 0) & (a["n"] + size <= limit)
            closed = F.when(a["n"] > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
            return F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["cur"], F.lit(glue), p).alias("cur"), (a["n"] + size).alias("n"))).otherwise(
                F.struct(closed.alias("done"), p.alias("cur"), size.alias("n"))
            )

        return F.aggregate(F.filter(parts, lambda p: ~t.is_blank(p)), empty, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))

    small = lambda x: t.token_count(x) <= limit
    words = lambda x: F.when(small(x), F.array(x)).otherwise(at(F.split(x, r"\s+"), " "))
    lines = lambda x: F.when(small(x), F.array(x)).otherwise(F.flatten(F.transform(at(F.split(x, "\n"), "\n"), words)))
    return F.when(small(text), F.array(text)).otherwise(F.flatten(F.transform(at(F.split(text, "\n\n"), "\n\n"), lines)))


def split_recursively(text: str, limit: int, of: Callable[[str], int], separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """The same in Python, for any counter; a word above the limit is cut between characters."""
    if of(text) <= limit or not separators:
        return [text]
    glue, rest = separators[0], separators[1:]
    out: list[str] = []
    for part in text.split(glue) if glue else list(text):
        if not part.strip():
            continue
        if out and of(out[-1] + glue + part) <= limit:
            out[-1] += glue + part
        else:
            out.append(part)
    return [x for piece in out for x in (split_recursively(piece, limit, of, rest) if of(piece) > limit else [piece])]


def _recursive_udf(text: Column, limit: int) -> Column:
    name, file = tokens.active()

    @F.pandas_udf("array<string>")
    def run(s):  # type: ignore[no-untyped-def]
        of = tokens.counter(name, file)
        return s.map(lambda x: None if x is None else split_recursively(x, limit, of))

    return run(text)


def by_size(parents: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """A splitter without embeddings: sentences, each a piece."""
    return parents.select("parent_id", F.posexplode(sentences(F.col("text"))).alias("at", "text"))


def parents(sections: DataFrame, blocks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, sec_idx, part, parts, ordinal, chunk_id, section_path, page, text, token_count)``."""
    parts = paragraph_parts(section_texts(blocks), cfg).join(sections.select("doc_id", "sec_idx", "section_path", F.col("page_start").alias("page")), ["doc_id", "sec_idx"])
    path = t.with_part(F.col("section_path"), F.col("part") + 1, F.col("parts"))
    out = numbered(parts.withColumn("section_path", path), ["doc_id"], "sec_idx", ["sec_idx", "part"], "ordinal")
    return out.withColumns({
        "chunk_id": t.chunk_id(F.col("doc_id"), F.col("section_path"), F.lit("parent"), F.col("ordinal"), F.col("text")), "token_count": t.token_count(F.col("text")),
    })


def pieces(of: DataFrame, splitter: Splitter = by_size, cfg: Settings = Settings()) -> DataFrame:
    """``parents`` to ``(parent_id, at, text)``. A parent of fewer than ``min_child_tokens`` is its own
    only piece, without any splitting; others are split by ``splitter``, what is still above
    ``max_child_tokens`` again by separators, and small pieces merged."""
    named = of.select(F.col("chunk_id").alias("parent_id"), "text", "token_count")
    tiny = named.filter(F.col("token_count") < cfg.min_child_tokens).select("parent_id", F.lit(0).alias("at"), "text")
    split = splitter(named.filter(F.col("token_count") >= cfg.min_child_tokens), cfg)
    again = split.select("parent_id", "at", F.posexplode(recursive_split(F.col("text"), cfg.max_child_tokens)).alias("k", "text"))
    flat = again.select("parent_id", F.struct("at", "k").alias("at"), "text")
    return tiny.unionByName(merge_pieces(flat, ["parent_id"], cfg.min_child_tokens))


def table_pieces(tables: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``tables(table_id, markdown, rows, caption, section_path)`` to ``(table_id, part, parts, split,
    text, rows)``.

    A table within ``max_child_tokens`` (caption and markdown), or without rows, is whole. Else its
    rows are packed under the header, which every piece repeats; a row is never split.
    """
    md = F.coalesce(F.nullif(F.col("markdown"), F.lit("")), t.grid_to_markdown(F.col("rows")))
    sized = tables.withColumn("_md", md).withColumn("_whole", t.table_text(F.col("caption"), F.col("_md")))
    fits = (t.token_count(F.col("_whole")) <= cfg.max_child_tokens) | (F.coalesce(F.size("rows"), F.lit(0)) == 0)
    whole = sized.filter(fits).select("table_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(False).alias("split"), F.col("_whole").alias("text"))
    head = F.slice("rows", 1, 1)
    width = t.widest(F.col("rows"))
    line = lambda r: t.markdown_row(t.pad(r, width))
    large = sized.filter(~fits).withColumns({"head": head, "body": F.slice("rows", 2, F.size("rows") - 1), "_headsize": t.token_count(line(F.col("rows")[0])) + width + width + 1})
    large = large.withColumn("room", F.lit(cfg.max_child_tokens) - F.col("_headsize")).withColumn("sizes", tokens.counts(F.transform("body", line))).withColumn("starts", folds.starts_before("sizes", "room"))
    grids = F.when(F.size("starts") > 0, folds.cut(F.col("body"), F.col("starts"))).otherwise(F.array(F.col("body")))  # a header alone is one piece
    each = large.select("table_id", "caption", "head", F.greatest(F.size("starts"), F.lit(1)).alias("parts"), F.posexplode(grids).alias("part", "mine"))
    text = t.table_text(F.col("caption"), t.grid_to_markdown(F.concat(F.col("head"), F.col("mine"))))
    return whole.unionByName(each.select("table_id", "part", "parts", F.lit(True).alias("split"), text.alias("text")))


def chunks(docs: DataFrame, sections: DataFrame, blocks: DataFrame, tables: DataFrame, splitter: Splitter = by_size, cfg: Settings = Settings()) -> DataFrame:
    """All chunks of prose documents: parents, children, table children, and for documents with a
    table in a section without text a synthetic root: ``(doc_id, chunk_id, parent_id, role,
    block_type, text, section_path, page, token_count, metadata, chunk_seq)``."""
    up = materialize(parents(sections, blocks, cfg), "prose-parents")
    texts = materialize(pieces(up, splitter, cfg), "prose-pieces").join(up.select(F.col("chunk_id").alias("parent_id"), "doc_id", "sec_idx", "part", "section_path", "page"), "parent_id")
    texts = texts.withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("at"))).select(
        "doc_id", "sec_idx", F.lit(False).alias("is_table"), F.col("part").alias("a"), F.col("k").alias("b"), "parent_id", "section_path", "page", "text", F.lit(None).cast("string").alias("metadata")
    )
    first = up.filter("part = 0").select("doc_id", "sec_idx", F.col("chunk_id").alias("parent_id"))
    placed = tables.join(sections.select("doc_id", "sec_idx", "section_path"), ["doc_id", "sec_idx"], "left")
    root = docs.select("doc_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id")).alias("text"), t.chunk_id(F.col("doc_id"), F.array().cast("array<string>"), F.lit("parent"), F.lit(-1), F.lit("document-root")).alias("root_id"))
    cut = table_pieces(placed, cfg).join(placed.select("table_id", "doc_id", "sec_idx", "tbl_seq", "section_path", "page"), "table_id")
    path = F.when(F.col("split"), t.with_table_part(F.col("section_path"), F.col("part") + 1, F.col("parts"))).otherwise(F.coalesce("section_path", F.array().cast("array<string>")))
    tabs = cut.join(first, ["doc_id", "sec_idx"], "left").join(root.select("doc_id", "root_id"), "doc_id").select(
        "doc_id", "sec_idx", F.lit(True).alias("is_table"), F.col("tbl_seq").alias("a"), F.col("part").alias("b"), F.coalesce("parent_id", "root_id").alias("parent_id"),
        path.alias("section_path"), "page", "text", F.to_json(F.struct("table_id")).alias("metadata"),
    )
    tabs = materialize(tabs, "table-pieces")
    roots = tabs.join(root, (tabs["parent_id"] == root["root_id"]) & (tabs["doc_id"] == root["doc_id"]), "left_semi").select("doc_id").distinct().join(root, "doc_id")
    down = numbered(texts.unionByName(tabs), ["doc_id"], "sec_idx", [F.col("sec_idx").asc_nulls_last(), "is_table", "a", "b"], "ordinal")
    kind = F.when(F.col("is_table"), "table").otherwise("text")
    children = down.select(
        "doc_id", t.chunk_id(F.col("doc_id"), F.col("section_path"), F.lit("child"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "parent_id", F.lit("child").alias("role"), kind.alias("block_type"),
        "text", "section_path", "page", "metadata", F.struct(F.lit(2).alias("r"), F.col("ordinal").alias("o")).alias("_o"),
    )
    null = F.lit(None).cast("string")
    ups = up.select("doc_id", "chunk_id", null.alias("parent_id"), F.lit("parent").alias("role"), F.lit("text").alias("block_type"), "text", "section_path", "page", null.alias("metadata"), F.struct(F.lit(1).alias("r"), F.col("ordinal").alias("o")).alias("_o"))
    tops = roots.select("doc_id", F.col("root_id").alias("chunk_id"), null.alias("parent_id"), F.lit("parent").alias("role"), F.lit("text").alias("block_type"), "text", F.array().cast("array<string>").alias("section_path"), F.lit(None).cast("int").alias("page"), F.lit('{"synthetic_root":true}').alias("metadata"), F.struct(F.lit(0).alias("r"), F.lit(0).alias("o")).alias("_o"))
    every = tops.unionByName(ups).unionByName(children)
    # roots come first, then parents, then children, each by its own number
    sizes = roots.select("doc_id", F.lit(1).alias("_roots")).join(up.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_parents")), "doc_id", "full")
    first = F.when(F.col("_o.r") > 0, F.coalesce("_roots", F.lit(0))).otherwise(0) + F.when(F.col("_o.r") > 1, F.coalesce("_parents", F.lit(0))).otherwise(0)
    placed = every.join(sizes, "doc_id", "left").withColumn("chunk_seq", (first + F.col("_o.o")).cast("int"))
    return placed.withColumn("token_count", t.token_count(F.col("text"))).drop("_o", "_roots", "_parents")


def tables_only(docs: DataFrame, tables: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Every table under a synthetic root of its document, whatever section it is in."""
    empty = docs.sparkSession.createDataFrame([], "doc_id string, sec_idx int, heading string, level int, section_path array<string>, page_start int, page_end int")
    nothing = docs.sparkSession.createDataFrame([], "doc_id string, sec_idx int, seq int, text string, block_order int, page int")
    return chunks(docs, empty, nothing, tables, by_size, cfg)
