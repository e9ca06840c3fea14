"""Which structure a document gets, and headings inferred from its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import text as t
from foliospark.operators.order import numbered, with_neighbours

NUMBERED = r"(?U)^\d+(\.\d+)*\s"
CLOSING = r"[.!?:;,]$"


def evidence(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with how many headings they have and the share of pages with one, to three digits."""
    heads = F.col("kind") == "heading"
    found = elements.groupBy("doc_id").agg(F.count_if(heads).alias("headings"), F.count_distinct(F.when(heads, F.col("page"))).alias("_pages"))
    pages = F.coalesce("page_count", F.lit(0))
    share = F.when(pages > 0, F.coalesce("_pages", F.lit(0)) / pages).otherwise(F.lit(0.0))
    return docs.drop("heading_coverage").join(found, "doc_id", "left").withColumns({"headings": F.coalesce("headings", F.lit(0)), "_share": share, "heading_coverage": F.bround(share, 3)}).drop("_pages")


def strategy(of: DataFrame, cfg: Settings = Settings(), inferred: Column | None = None) -> DataFrame:
    """``evidence`` with ``parent_strategy``. ``inferred`` says whether inferred headings may be used;
    they come before pages."""
    enough = F.col("headings") >= cfg.min_headings_for_structure
    covered = (F.col("file_type") != "pdf") | (F.col("_share") >= cfg.min_heading_page_coverage)
    chosen = (
        F.when(F.col("file_type") == "pptx", "SLIDE")
        .when(enough & covered, "HEADING")
        .when(F.col("file_type") == "docx", "FLAT")
        .when(inferred if inferred is not None else F.lit(False), "LLM_INFERRED")
        .otherwise("PAGE")
    )
    return of.withColumn("parent_strategy", chosen).drop("_share")


def is_candidate(line: Column, page_start: Column, longest: int) -> Column:
    """Whether a line may be a heading: short, and not closed like a sentence unless numbered or at
    the start of a page."""
    return _is_candidate(t.strip(line), page_start, longest)


def _is_candidate(x: Column, page_start: Column, longest: int) -> Column:
    """The same of a line without white space at its ends."""
    return (x != "") & (F.length(x) <= longest) & (~x.rlike(CLOSING) | x.rlike(NUMBERED) | F.coalesce(page_start, F.lit(False)))


def candidates(elements: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, line_id, seq, line, text, page, before, after)``: candidate lines in order, with the
    lines around them. ``line`` counts all lines of the element."""
    raw = F.transform(t.split_lines(F.col("text")), lambda x, i: F.struct(i.alias("line"), t.strip(x).alias("text")))
    said = elements.filter(F.col("kind") == "text").select("doc_id", "seq", "page", "is_page_start", F.filter(raw, lambda x: x["text"] != "").alias("lines")).filter(F.size("lines") > 0)
    # what is beside a line is in its element, but for the first and last: these ask the elements around
    said = with_neighbours(said, ["doc_id"], "seq", ["seq"], F.element_at("lines", 1)["text"], F.element_at("lines", -1)["text"], "_before", "_after")
    beside = F.transform("lines", lambda x, i: F.struct(
        x["line"].alias("line"), x["text"].alias("text"), F.when(i > 0, F.get("lines", i - 1)["text"]).otherwise(F.coalesce("_before", F.lit(""))).alias("before"),
        F.when(i < F.size("lines") - 1, F.get("lines", i + 1)["text"]).otherwise(F.coalesce("_after", F.lit(""))).alias("after"),
    ))
    lines = said.select("doc_id", "seq", "page", "is_page_start", F.inline(beside))
    start = F.coalesce("is_page_start", F.lit(False)) & (F.col("line") == 0)
    kept = lines.filter(_is_candidate(F.col("text"), start, cfg.max_heading_chars))
    kept = numbered(kept, ["doc_id"], "seq", ["seq", "line"], "_no")
    return kept.select("doc_id", F.concat(F.lit("L"), F.col("_no").cast("string")).alias("line_id"), "seq", "line", "text", "page", "before", "after")


#: What a language model is asked; candidates follow as a JSON array.
PROMPT = (
    "Below are lines of a document as a JSON array, each with the lines before and after it. Say which are headings of sections and how deep. "
    "Answer with a JSON array of objects with line_id, is_heading and level (1 to 4), and nothing else.\n\n"
)


def asking(call: Callable[[str], str]) -> Callable[[Column], Column]:
    """A classifier of a Python function from prompt to answer, run on executors; whatever goes wrong
    in it is no answer."""

    def classify(payload: Column) -> Column:
        @F.pandas_udf("string")
        def run(s):  # type: ignore[no-untyped-def]
            def ask(x: str | None) -> str | None:
                try:
                    return call(PROMPT + x) if x else None
                except Exception:  # noqa: BLE001 - documents without an answer go on by pages
                    return None

            return s.map(ask)

        return run(payload)

    return classify


def confirmed(lines: DataFrame, classify: Callable[[Column], Column], cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, seq, line, level)`` of candidates that ``classify`` confirms.

    ``classify`` maps a JSON array of candidates to a JSON array of ``{line_id, is_heading, level}``;
    it is asked again if the first answer isn't one. Documents without candidates, or with more than
    ``max_heading_candidates``, aren't asked; unknown lines are dropped; levels are held to 1..4.
    """
    item = F.struct("seq", "line", F.struct("line_id", "text", "page", "before", "after").alias("j"))
    few = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cfg.max_heading_candidates).select("doc_id")
    asked = (
        lines.join(few, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(item)).alias("c"))
        .select("doc_id", F.to_json(F.transform("c", lambda c: c["j"]), {"ignoreNullFields": "false"}).alias("payload"))
    )
    shape = "array<struct<line_id:string,is_heading:boolean,level:string>>"
    once = asked.withColumn("answer", F.from_json(classify(F.col("payload")), shape))
    twice = once.withColumn("answer", F.coalesce("answer", F.from_json(classify(F.col("payload")), shape)))
    said = twice.select("doc_id", F.explode("answer").alias("a")).filter("a.is_heading").select("doc_id", "a.line_id", "a.level")
    level = F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(level as int)"), F.lit(1))))
    return lines.join(said.dropDuplicates(["doc_id", "line_id"]), ["doc_id", "line_id"]).select("doc_id", "seq", "line", level.alias("level"))


def promoted(elements: DataFrame, heads: DataFrame) -> DataFrame:
    """Elements with text split into lines and confirmed lines made headings, renumbered."""
    texts = elements.filter(F.col("kind") == "text").select("*", F.posexplode(t.split_lines(F.col("text"))).alias("line", "_text")).drop("text").withColumnRenamed("_text", "text")
    texts = texts.drop("level").join(heads, ["doc_id", "seq", "line"], "left").withColumn("kind", F.when(F.col("level").isNotNull(), "heading").otherwise("text"))
    others = elements.filter(F.col("kind") != "text").withColumn("line", F.lit(0))
    every = texts.unionByName(others.select(texts.columns)).withColumnRenamed("seq", "_seq")
    return numbered(every, ["doc_id"], "_seq", ["_seq", "line"], "seq").drop("_seq", "line")


def section_coverage(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, coverage)``: pages on which a headed section starts, of all; 1 if unknown."""
    heads = sections.filter(F.col("heading").isNotNull()).groupBy("doc_id").agg(F.count_distinct("page_start").alias("_p"))
    known = F.coalesce("page_count", F.lit(0)) > 0
    return docs.join(heads, "doc_id", "left").select("doc_id", F.when(known, F.coalesce("_p", F.lit(0)) / F.col("page_count")).otherwise(F.lit(1.0)).alias("coverage"))


def quality_gate(elements: DataFrame, docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` with ``error`` set where a PDF yielded fewer than ``min_chars_per_page`` characters a
    page; tables count for nothing, earlier errors stay."""
    chars = elements.filter(F.col("kind") != "table").groupBy("doc_id").agg(F.sum(F.length("text")).alias("_chars"))
    per = F.coalesce("_chars", F.lit(0)) / F.greatest(F.coalesce("page_count", F.lit(0)), F.lit(1))
    low = (F.col("file_type") == "pdf") & (per < cfg.min_chars_per_page)
    return docs.join(chars, "doc_id", "left").withColumn("error", F.coalesce("error", F.when(low, F.concat(F.lit("low extraction quality: "), F.bround(per, 1).cast("string"), F.lit(" characters a page"))))).drop("_chars")
