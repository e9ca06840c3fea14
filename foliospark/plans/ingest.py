"""From files to chunks and results, as one plan over all files."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Settings, enforce_offline
from foliospark.deploy import ship
from foliospark.functions import tokens
from foliospark.operators import ladder, prose, providers, sections, semantic, sheets, slides, stats
from foliospark.sources import files
from foliospark.sources.decoders import REGISTRY, Registry
from foliospark.workspace import materialize

CHUNK = (
    "chunk_id", "doc_id", "parent_id", "role", "block_type", "text", "section_path", "source_uri", "file_type", "page", "slide_number", "sheet_name",
    "row_range", "token_count", "metadata", "chunk_seq",
)
_TYPES = {"page": "int", "slide_number": "int", "sheet_name": "string", "row_range": "array<int>", "metadata": "string"}


@dataclass(frozen=True)
class Ingested:
    docs: DataFrame
    chunks: DataFrame
    results: DataFrame


def chunker(file_type: Column) -> Column:
    """Which chunker a file goes to: ``prose``, ``slide`` or ``row``; null for other files."""
    kind = F.lower(file_type)
    return F.when(kind.isin("pdf", "docx"), "prose").when(kind == "pptx", "slide").when(kind.isin("xlsx", "csv"), "row")


def _shaped(df: DataFrame, docs: DataFrame) -> DataFrame:
    for name, kind in _TYPES.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.join(docs.select("doc_id", "source_uri", "file_type"), "doc_id").select(*CHUNK)


def chunk_elements(docs: DataFrame, elements: DataFrame, cfg: Settings = Settings(), splitter: prose.Splitter | None = None, classify=None) -> tuple[DataFrame, DataFrame]:  # type: ignore[no-untyped-def]
    """Documents with their strategy, and the chunks of prose and slides; ``classify`` confirms
    heading candidates where that is enabled."""
    splitter = splitter or prose.by_size
    known = ladder.evidence(elements, docs)
    if cfg.enable_llm_toc_inference and classify is not None:
        plain = ladder.strategy(known, cfg).filter("parent_strategy = 'PAGE' and file_type = 'pdf'").select("doc_id")
        asked = elements.join(plain, "doc_id", "left_semi")
        heads = materialize(ladder.confirmed(ladder.candidates(asked, cfg), classify, cfg), "confirmed-headings")
        rebuilt = ladder.promoted(asked.join(heads.select("doc_id").distinct(), "doc_id", "left_semi"), heads)
        inferred = sections.by_headings(rebuilt)
        covered = ladder.section_coverage(inferred.sections, docs).join(heads.select("doc_id").distinct(), "doc_id", "left_semi")
        good = covered.filter(F.col("coverage") >= cfg.min_heading_page_coverage).select("doc_id", F.lit(True).alias("_inferred"))
        known = ladder.strategy(known.join(good, "doc_id", "left"), cfg, F.coalesce("_inferred", F.lit(False))).drop("_inferred")
    else:
        rebuilt = None
        known = ladder.strategy(known, cfg)
    known = materialize(known, "strategies")  # each table below is read several times
    of = lambda df, *names: df.join(known.filter(F.col("parent_strategy").isin(*names)).select("doc_id"), "doc_id", "left_semi")
    built = [sections.by_headings(of(elements, "HEADING")), sections.by_pages(of(elements, "PAGE"), cfg), sections.flat(of(elements, "FLAT"))]
    if rebuilt is not None:
        built.append(sections.by_headings(of(rebuilt, "LLM_INFERRED")))
    parts = [sections.Parts(*[x.select(*cols) for x, cols in zip((b.sections, b.blocks, b.tables), (_SECTION, _BLOCK, _TABLE))]) for b in built]
    every = parts[0]
    for p in parts[1:]:
        every = sections.Parts(every.sections.unionByName(p.sections), every.blocks.unionByName(p.blocks), every.tables.unionByName(p.tables))
    every = sections.Parts(*[materialize(x, "section-parts") for x in (every.sections, every.blocks, every.tables)])
    text = _shaped(prose.chunks(of(docs, "HEADING", "PAGE", "FLAT", "LLM_INFERRED"), every.sections, every.blocks, every.tables, splitter, cfg), docs)
    deck = sections.by_slides(of(elements, "SLIDE"), of(docs, "SLIDE"))
    shown_blocks = slides.with_tables(deck.blocks, deck.tables) if cfg.emit_slide_tables else deck.blocks
    deck = sections.Parts(materialize(deck.sections, "slides"), materialize(shown_blocks, "slide-blocks"), deck.tables)
    shown = _shaped(slides.chunks(deck.sections, deck.blocks, splitter, cfg), docs)
    empty = slides.slides(deck.sections, deck.blocks).groupBy("doc_id").agg(F.count_if("empty").cast("int").alias("empty_slides"))
    return known.join(empty, "doc_id", "left"), materialize(text, "text-chunks").unionByName(materialize(shown, "slide-chunks"))


_SECTION = ("doc_id", "sec_idx", "section_id", "heading", "level", "section_path", "page_start", "page_end")
_BLOCK = ("doc_id", "sec_idx", "seq", "block_id", "text", "page", "block_order")
_TABLE = ("doc_id", "sec_idx", "seq", "tbl_seq", "table_id", "markdown", "rows", "caption", "page")


def ingest(found: DataFrame, cfg: Settings = Settings(), registry: Registry = REGISTRY, embed: semantic.Embedder | None = None, classify=None) -> Ingested:  # type: ignore[no-untyped-def]
    """``found`` from ``files.scan`` to documents, chunks and results. Every file gives a result; what
    goes wrong with one stays with it.

    Prose is split by meaning with ``embed``, or the embedder of ``cfg.embedding_provider``, whose vectors
    are kept (``cache_dir``); only for the default settings its library may be missing, and sentences are
    then joined by size. Headings are confirmed by ``classify``, or the model of ``cfg.llm_provider``. Sizes are those of ``cfg.token_counter``.
    """
    if cfg.offline:
        enforce_offline()
    if cfg.enable_llm_toc_inference and classify is None:
        classify = ladder.asking(providers.answers(cfg))
    with tokens.using(cfg):
        return _ingest(found, cfg, registry, _splitter(found.sparkSession, cfg, embed), classify)


def _splitter(spark: SparkSession, cfg: Settings, embed: semantic.Embedder | None) -> prose.Splitter:
    try:
        chosen = semantic.embedder(cfg, embed)
    except ImportError as missing:
        if cfg.embedding_provider != Settings.embedding_provider:
            raise
        warnings.warn(f"{missing}: no embedder for {cfg.embedding_provider!r}, prose is split by size, not by meaning", stacklevel=3)
        return prose.by_size
    # only the vectors of the configured model are kept: one that is given may be any
    return semantic.splitter(chosen, cache=semantic.cache_path(spark, cfg) if embed is None else None)


def _ingest(found: DataFrame, cfg: Settings, registry: Registry, splitter: prose.Splitter, classify) -> Ingested:  # type: ignore[no-untyped-def]
    ship(found.sparkSession)
    decoded = materialize(files.decode(found, registry), "decoded-files")
    items = materialize(files.elements(decoded), "elements")
    gated = materialize(ladder.quality_gate(items, files.documents(decoded), cfg), "documents")
    good = gated.filter("error is null")
    laid = good.filter(chunker(F.col("file_type")).isin("prose", "slide"))
    known, written = chunk_elements(laid, items.join(laid.select("doc_id"), "doc_id", "left_semi"), cfg, splitter, classify)
    rows, heads = (materialize(x, "sheets") for x in sheets.from_grid(files.grids(decoded), cfg))
    tabular = _shaped(sheets.chunks(rows, heads, cfg), good)
    chunks = materialize(written.unionByName(tabular), "ingested-chunks")
    flags = sheets.profile(rows, heads, cfg).groupBy("doc_id").agg(F.bool_or("guarded").alias("guarded"), F.bool_or("sparse_sheet").alias("sparse_sheet"))
    docs = gated.join(known.select("doc_id", "headings", "heading_coverage", "parent_strategy", "empty_slides"), "doc_id", "left").join(flags, "doc_id", "left")
    return Ingested(docs, chunks, stats.results(docs.fillna(False, ["guarded", "sparse_sheet"]), chunks))


def ingest_folder(spark: SparkSession, folder: str, cfg: Settings = Settings(), glob: str = "*", **how) -> Ingested:  # type: ignore[no-untyped-def]
    return ingest(files.scan(spark, folder, how.get("registry", REGISTRY), glob), cfg, **how)


def ingest_file(spark: SparkSession, path: str, cfg: Settings = Settings(), **how) -> Ingested:  # type: ignore[no-untyped-def]
    """One file, as ``ingest_folder`` does many."""
    return ingest(files.scan(spark, path, how.get("registry", REGISTRY)), cfg, **how)


def log_events(results: DataFrame) -> DataFrame:
    """Each result as one line of JSON, named for whether the file failed."""
    event: Column = F.when(F.col("status") == "failed", "ingest_failed").otherwise("ingest_ok")
    return results.select(F.to_json(F.struct(event.alias("event"), *results.columns)).alias("line"))
