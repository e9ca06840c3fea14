"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import near_duplicates as nd
from foliospark.llm import quality as ql
from foliospark.llm import reading as rd
from foliospark.llm import scan_repair as sr
from foliospark.llm import tokens as tk
from foliospark.llm import tree_split as ts
from foliospark.llm.fill import fill
from foliospark.llm.mix import mix
from foliospark.tables import deployed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = deployed(f)
    return f


def _same_uri(uri: Column) -> Column:
    """One spelling for the same file: percent-decoded (a plus sign stays itself), lower-cased."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri))


def _child_texts(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "chunks")
        .filter("role = 'child' and block_type = 'text'")
        .select(F.col("chunk_id").alias("id"), _same_uri(F.col("source_uri")).alias("owner"), "text")
    )


#: What revised copies are in this project; near-duplicates elsewhere are of five words and 0.8.
_REVISED = nd.Similarity(words=3, threshold=0.5, least=40)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = nd.near(_child_texts(spark, d), _REVISED)
    return nd.pairs(found).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


@query
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class form of the same links."""
    return nd.groups(nd.near(_child_texts(spark, d), _REVISED)).withColumnRenamed("id", "chunk_id")


ORACLES["p1_found"] = r"""
with c as (select distinct on (chunk_id) chunk_id, lower(url_decode(coalesce(source_uri, ''))) as owner, source_uri is null as ownerless,
    list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from chunks where role = 'child' and block_type = 'text' and text is not null),
s as (select chunk_id, owner, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: hash(w[i], w[i + 1], w[i + 2])))) as h from c where len(w) >= 42 and not ownerless),
k as (select chunk_id, count(*) as n from s group by chunk_id having n >= 40),
m as (select a.chunk_id as chunk_a, b.chunk_id as chunk_b, count(*) as o from s a join s b on a.h = b.h and a.chunk_id < b.chunk_id and a.owner <> b.owner group by all)
select chunk_a, chunk_b from m join k x on x.chunk_id = chunk_a join k y on y.chunk_id = chunk_b where o >= 0.5 * (x.n + y.n - o)
"""


_SETS = ORACLES["p1_found"].split("m as (")[0].rstrip().removesuffix(",").replace(" and not ownerless", "").replace(", source_uri is null as ownerless", "")
ORACLES["p1_groups"] = (
    "with recursive"
    + _SETS.split("with", 1)[1]
    + r""",
g as (select chunk_id, md5(string_agg(cast(h as varchar), ',' order by h)) as sig from s join k using (chunk_id) group by chunk_id),
r as (select sig, min(chunk_id) as rep from g group by sig),
t as (select rep, h from s join r on s.chunk_id = r.rep),
o as (select a.rep as a, b.rep as b, count(*) as o from t a join t b on a.h = b.h and a.rep < b.rep group by all),
m as (select a, b from o join k x on x.chunk_id = a join k y on y.chunk_id = b where o >= 0.5 * (x.n + y.n - o)),
e as (select a, b from m union all select b, a from m),
reach as (select rep as a, rep as b from r union select reach.a, e.b from reach join e on e.a = reach.b),
c1 as (select a, min(b) as class_id from reach group by a)
select g.chunk_id, class_id, (select count(*) from e where e.a = r.rep) as links from g join r using (sig) join c1 on c1.a = r.rep
"""
)


def _to_split(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "size_limits")
    kind = F.concat(F.col("role"), F.lit("_chunk"))
    texts = table(spark, d, "chunks").select(kind.alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    tables = table(spark, d, "table_blocks").select(F.lit("table_block").alias("item_kind"), F.col("table_id").alias("item_id"), "table_rows")
    sections = table(spark, d, "sections").select("doc_id", "sec_idx", "section_id").dropDuplicates(["section_id"])
    key = F.concat_ws("\u001f", "doc_id", "sec_idx")
    blocks = table(spark, d, "blocks").select(key.alias("item_id"), "block_id", F.col("block_order").alias("place"), "text")
    cols = ("item_kind", "item_id", "item_tokens", "max_tokens", "overlap_tokens", "span", "lead", "text", "table_rows")
    of_sections = ts.blocks_to_split(blocks, limits).join(sections.select(key.alias("item_id"), "section_id"), "item_id").drop("item_id").withColumnRenamed("section_id", "item_id")
    return ts.texts_to_split(texts, limits).select(*cols).unionByName(ts.tables_to_split(tables, limits).select(*cols)).unionByName(of_sections.select(*cols))


@query
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return ts.split(_to_split(spark, d))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("item_kind", "item_id").distinct()


ORACLES["p2_found"] = r"""
with tok as (
  select role || '_chunk' as item_kind, chunk_id as item_id, len(regexp_extract_all(coalesce(text, ''), '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) as n from chunks
  union all
  select 'section', s.section_id, b.n from (
    select doc_id, sec_idx, sum(n) as n from (
      select distinct doc_id, sec_idx, block_id, len(regexp_extract_all(coalesce(text, ''), '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) as n from blocks
    ) group by doc_id, sec_idx
  ) b join (select distinct doc_id, sec_idx, section_id from sections) s using (doc_id, sec_idx)
  union all
  select 'table_block', table_id, list_sum(list_transform(flatten(table_rows), lambda c: len(regexp_extract_all(coalesce(c, ''), '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')))) from table_blocks
)
select distinct item_kind, item_id from tok join size_limits using (item_kind) where n > max_tokens
"""


@query
def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item hold of its own, and how many are above the limit."""
    own = F.sum(F.col("tokens") - F.col("shared_tokens")) + F.sum(F.when(F.col("piece_no") == 0, F.col("shared_tokens")).otherwise(0))
    return p2_pieces(spark, d).groupBy("item_kind", "item_id", "item_tokens").agg(own.alias("covered_tokens"), F.count_if(F.col("tokens") > F.col("max_tokens")).alias("too_large"))


ORACLES["p2_coverage"] = ORACLES["p2_found"].replace("select distinct item_kind, item_id from tok", "select distinct item_kind, item_id, cast(n as bigint) as item_tokens, cast(n as bigint) as covered_tokens, 0 as too_large from tok")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tk.with_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text", "tokens")


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return fill(_sizes(spark, d).select(F.col("doc_id").alias("key"), "tokens"), capacity=2048)


@query
def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return _containers(spark, d).withColumnRenamed("key", "doc_id")


@query
def p5_usage(spark: SparkSession, d: str) -> DataFrame:
    bins = _containers(spark, d).filter("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("items"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("held").alias("tokens"),
        F.max("held").alias("fullest"), F.round(F.sum("held") / (F.count(F.lit(1)) * 2048), 5).alias("used_share"),
    )


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    records = _sizes(spark, d).select(F.col("doc_id").alias("key"), F.array(plain(F.col("source"))).alias("sources"), "tokens")
    return mix(records, table(spark, d, "mix_targets"))


@query
def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("key", "doc_id")


@query
def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _kinds(spark: SparkSession, d: str, of: str = "true") -> DataFrame:
    """The kinds of the child chunks that ``of`` holds for."""
    texts = table(spark, d, "chunks").filter("role = 'child'").select(F.col("chunk_id").alias("id"), "block_type", "text")
    labels = table(spark, d, "quality_labels").select(F.col("chunk_id").alias("id"), "annotator", "label")
    rules, common = ql.learn(texts, labels)
    return ql.classify(texts.filter(of), "text", rules, common)


@query
def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).drop("text").withColumnRenamed("id", "chunk_id").dropDuplicates(["chunk_id"])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    misfit = "(block_type = 'text' and kind <> 'prose') or (block_type = 'table' and kind = 'prose')"
    return _kinds(spark, d, "block_type in ('text', 'table') and length(text) >= 100").filter(misfit).select(F.col("id").alias("chunk_id")).distinct()


def _levels(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    plain = rd.function_words(table(spark, d, "word_list"))
    model = rd.fit(texts, table(spark, d, "level_labels").select(F.col("doc_id").alias("id"), "level", "grader"), plain)
    return rd.levels(texts, model, plain)


@query
def p7_word_grades(spark: SparkSession, d: str) -> DataFrame:
    """The acquisition grade of each word of at least five graded documents."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cases = rd.graded_texts(texts, table(spark, d, "level_labels").select(F.col("doc_id").alias("id"), "level", "grader"))
    grades = rd.word_grades(cases)
    return spark.createDataFrame([(w, round(g, 6)) for w, g in grades.items()], "word string, grade double")  # a row a graded word


ORACLES["p7_word_grades"] = r"""
with l as (select doc_id, avg(level) as level from (select distinct doc_id, level, grader from level_labels where level between 1 and 5) group by doc_id),
t as (select cast(least(5, greatest(1, round_even(level, 0))) as integer) as grade, text from l join documents using (doc_id) where text is not null),
w as (select grade, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+(?:[-''’][\p{L}\p{Nl}\p{No}]+)*'))) as word from t),
z as (select count(*) filter (grade = 1) as s1, count(*) filter (grade = 2) as s2, count(*) filter (grade = 3) as s3, count(*) filter (grade = 4) as s4, count(*) filter (grade = 5) as s5 from t),
n as (select word, count(*) filter (grade = 1) as n1, count(*) filter (grade = 2) as n2, count(*) filter (grade = 3) as n3, count(*) filter (grade = 4) as n4, count(*) filter (grade = 5) as n5 from w group by word having count(*) >= 5),
r as (select word, [(n1 + 0.1) / (s1 + 1), (n2 + 0.1) / (s2 + 1), (n3 + 0.1) / (s3 + 1), (n4 + 0.1) / (s4 + 1), (n5 + 0.1) / (s5 + 1)] as a from n, z),
p as (select word, list_transform(a, lambda x: x / list_sum(a)) as a from r),
c as (select word, a, list_transform([1, 2, 3, 4, 5], lambda i: list_sum(a[:i])) as u from p),
k as (select *, len(list_filter(u, lambda x: x < 0.5)) + 1 as k from c)
select word, round(k - 1 + (0.5 - (u[k] - a[k])) / a[k] + 0.5, 6) as grade from k
"""


@query
def p7_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).withColumnRenamed("id", "doc_id")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("is_prose and level >= 4").select(F.col("id").alias("doc_id")).distinct()


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, sr.Lexicon]:
    blocks = table(spark, d, "blocks")
    sure = frozenset(r["word"] for r in table(spark, d, "word_list").filter("word is not null").collect())  # a fixed list
    return blocks, sr.learn(blocks, sure)


@query
def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    blocks = sr.repair(*_scanned(spark, d)).filter("text <> ''")
    part = F.struct("sec_idx", "block_order", "block_id", "text")
    return blocks.groupBy("doc_id", "paragraph_id").agg(
        F.min("page").alias("page"), F.count(F.lit(1)).alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " ").alias("text")
    )


@query
def p4_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each block of its document when its paragraphs are read one after the other."""
    blocks = sr.repair(*_scanned(spark, d))
    begins = blocks.filter("block_id = paragraph_id").select("paragraph_id", F.struct("sec_idx", "block_order", "block_id").alias("begin"))
    own = Window.partitionBy("doc_id", F.floor(F.col("begin.sec_idx") / 4096)).orderBy("begin", "sec_idx", "block_order", "block_id")
    return blocks.join(begins, "paragraph_id").select("doc_id", "block_id", F.row_number().over(own).alias("place"))


ORACLES["p4_reading_order"] = """
with b as (select distinct on (block_id) block_id, doc_id, sec_idx, block_order from blocks)
select doc_id, block_id, cast(row_number() over (partition by doc_id, floor(sec_idx / 4096) order by sec_idx, block_order, block_id) as integer) as place from b
"""


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sr.texts(*_scanned(spark, d)).select("block_id", F.explode("noise").alias("noise")).distinct()


def _repaired_chunks(chunks: DataFrame, lexicon: sr.Lexicon) -> DataFrame:
    """``(chunk_id, noise, text)`` of the chunks of every page-like file, whatever their ``block_type``.

    Parents and children repeat one another, so each role is a reading order of its own. Grids stay
    as they are, and outside of that order. Sheets and slides aren't scanned.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    grid = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$"))) * 2 > F.size(lines)
    pages = chunks.filter("coalesce(lower(file_type), '') not in ('csv', 'xlsx', 'pptx')").withColumn("grid", grid)
    order = F.concat_ws("\u001f", "role", "doc_id")
    read = pages.filter("not grid").select(
        order.alias("doc_id"), F.floor(F.col("chunk_seq") / 8).cast("int").alias("sec_idx"), F.col("chunk_id").alias("block_id"), F.col("chunk_seq").alias("block_order"), "page", "text"
    )
    kept = pages.filter("grid").dropDuplicates(["chunk_id"]).select("chunk_id", F.array().cast("array<string>").alias("noise"), "text")
    return sr.texts(read, lexicon).select(F.col("block_id").alias("chunk_id"), "noise", "text").unionByName(kept)


@query
def p4_chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk.text repaired with the lexicon of the blocks; parents and children each in their order."""
    sure = frozenset(r["word"] for r in table(spark, d, "word_list").filter("word is not null").collect())
    return _repaired_chunks(table(spark, d, "chunks"), sr.learn(table(spark, d, "blocks"), sure))


_PLAIN = ("mean_word_length", "symbol_ratio", "closed_line_share", "common_share", "digit_ratio", "vowel_ratio", "mean_line_words", "separators_per_word", "long_word_share", "distinct_share", "number_word_share")


@query
def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The plain statistics of each child chunk; common words are those of word_list."""
    words = [r["word"] for r in table(spark, d, "word_list").filter("word is not null").orderBy("word_rank", "word").collect()]  # a fixed list
    texts = table(spark, d, "chunks").filter("role = 'child'").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    of = ql.with_statistics(texts, "text", words)
    return of.select("chunk_id", F.col("n_words").cast("bigint").alias("n_words"), *[F.round(c, 6).alias(c) for c in _PLAIN])


_WHITE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ORACLES["p3_statistics"] = rf"""
with c as (select distinct on (chunk_id) chunk_id, coalesce(text, '') as t from chunks where role = 'child'),
s as (select *, len(regexp_extract_all(t, '[^{_WHITE}]+')) as n, length(regexp_replace(t, '[{_WHITE}]+', '', 'g')) as ch, length(regexp_replace(t, '[\p{{L}}\p{{M}}0-9{_WHITE}]+', '', 'g')) as sy,
  list_filter(string_split_regex(t, '[\r\n]+'), lambda x: trim(x, ' ') <> '') as ls, list_distinct(list_filter(string_split_regex(lower(t), '[^\p{{L}}\p{{M}}]+'), lambda x: x <> '')) as ws,
  list_filter(string_split_regex(lower(t), '[^\p{{L}}\p{{M}}]+'), lambda x: x <> '') as aw, regexp_extract_all(t, '[^{_WHITE}]+') as ts from c),
w as (select list(distinct word) as known from word_list)
select chunk_id, n as n_words, round(case when n > 0 then ch / n else 0 end, 6) as mean_word_length, round(case when ch > 0 then sy / ch else 0 end, 6) as symbol_ratio,
  round(case when len(ls) > 0 then len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '[.!?:;…。]$'))) / len(ls) else 0 end, 6) as closed_line_share,
  round(case when len(ws) > 0 then len(list_intersect(ws, known)) / len(ws) else 0 end, 6) as common_share,
  round(case when ch > 0 then length(regexp_replace(t, '[^0-9]+', '', 'g')) / ch else 0 end, 6) as digit_ratio,
  round(case when la * 2 > length(al) then (length(al) - length(translate(al, '{ql.VOWELS}', ''))) / la else 0.4 end, 6) as vowel_ratio,
  round(case when len(ls) > 0 then n / len(ls) else 0 end, 6) as mean_line_words,
  round(case when n > 0 then length(regexp_replace(t, '[^|\t;]+', '', 'g')) / n else 0 end, 6) as separators_per_word,
  round(case when n > 0 then len(list_filter(ts, lambda x: length(x) > 24)) / n else 0 end, 6) as long_word_share,
  round(case when len(aw) > 0 then len(ws) / len(aw) else 0 end, 6) as distinct_share,
  round(case when n > 0 then len(list_filter(ts, lambda x: regexp_matches(x, '\d'))) / n else 0 end, 6) as number_word_share
from (select s.*, array_to_string(aw, '') as al, length(array_to_string(aw, '')) - length(regexp_replace(array_to_string(aw, ''), '[a-zà-ɏ]+', '', 'g')) as la from s) s, w
"""
