"""Every query of the engine's own operators, by name, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import text as t
from foliospark.operators import jobs, ladder, prose, semantic, sheets, slides, stats
from foliospark.operators import sections as sec
from foliospark.plans import ingest
from foliospark.tables import deployed, table
from foliospark.workspace import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CFG = Settings()

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '\\S+'))"


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = deployed(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- identifiers, sizes, scalars ------------------------------------------------------------------


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))


@query(
    "select distinct chunk_id, substr(sha256(concat_ws(chr(31), doc_id, coalesce(array_to_string(section_path, ' > '), ''), role, cast(chunk_seq as varchar), coalesce(text, ''))), 1, 16) as own_id from chunks"
)
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    own = t.chunk_id(F.col("doc_id"), F.col("section_path"), F.col("role"), F.col("chunk_seq"), F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", own.alias("own_id")).distinct()


@query("select distinct doc_id, substr(sha256(concat_ws(chr(31), source_uri, '1700000000.5')), 1, 16) as own_id from docs")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", t.doc_id(F.col("source_uri"), F.lit("1700000000.5")).alias("own_id")).distinct()


@query(
    """select section_id as given_id, doc_id || '-sec-' || sec_idx as own_id from (select distinct section_id, doc_id, sec_idx from sections)
    union all select block_id, doc_id || '-sec-' || sec_idx || '-b' || (row_number() over (partition by doc_id, sec_idx order by block_order, block_id) - 1) from (select distinct block_id, doc_id, sec_idx, block_order from blocks)
    union all select table_id, doc_id || '-tbl-' || (row_number() over (partition by doc_id order by sec_idx, tbl_seq, table_id) - 1) from (select distinct table_id, doc_id, sec_idx, tbl_seq from table_blocks)"""
)
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of sections, blocks and tables, as builders give them."""
    sections = table(spark, d, "sections").select("doc_id", "sec_idx", F.col("section_id").alias("given_id")).distinct()
    blocks = table(spark, d, "blocks").select("doc_id", "sec_idx", F.struct("block_order", "block_id").alias("seq"), F.col("block_id").alias("given_id")).distinct()
    tabs = table(spark, d, "table_blocks").select("doc_id", "sec_idx", F.struct("tbl_seq", "table_id").alias("seq"), F.col("table_id").alias("given_id")).distinct()
    parts = sec.with_ids(sections, blocks, tabs)
    out = parts.sections.select("given_id", F.col("section_id").alias("own_id"))
    return out.unionByName(parts.blocks.select("given_id", F.col("block_id").alias("own_id"))).unionByName(parts.tables.select("given_id", F.col("table_id").alias("own_id")))


@query(f"select distinct chunk_id, token_count, {_tokens('text')} as recount from chunks where token_count is null or token_count <> {_tokens('text')}")
def token_drift(spark: SparkSession, d: str) -> DataFrame:
    recount = t.token_count(F.col("text"))
    return table(spark, d, "chunks").withColumn("recount", recount).filter("token_count is null or token_count <> recount").select("chunk_id", "token_count", "recount").distinct()


@query(
    """select doc_id, case when lower(file_type) in ('pdf', 'docx') then 'prose' when lower(file_type) = 'pptx' then 'slide'
    when lower(file_type) in ('xlsx', 'csv') then 'row' end as chunker from (select distinct doc_id, file_type from docs)"""
)
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", "file_type").distinct().select("doc_id", ingest.chunker(F.col("file_type")).alias("chunker"))


# --- sheets ----------------------------------------------------------------------------------------


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = {"c_custkey": F.col("c_custkey"), "c_name": F.col("c_name"), "c_nationkey": F.col("c_nationkey"), "c_acctbal": _money("c_acctbal"), "c_mktsegment": F.col("c_mktsegment")}
    return sheets.from_table(table(spark, d, "customer"), "customer", "c_custkey", cells)


_ROW_LINES = """
select cast(row_number() over (order by c_custkey) - 1 as integer) as row_idx,
  'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_acctbal: ' || cast(c_acctbal as decimal(18,2)) || ' | c_mktsegment: ' || c_mktsegment as line
from customer
"""
_ROW_BATCHES = f"""
lines as ({_ROW_LINES}), sized as (select row_idx, line, {_tokens("line")} as n from lines),
walk as (
  select row_idx, 0 as g, case when n >= 400 then 0 else 1 end as k, case when n >= 400 then 0 else n end as tk, case when n >= 400 then 1 else 0 end as ng from sized where row_idx = 0
  union all
  select s.row_idx, w.ng, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.k + 1 end, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.tk + s.n end,
    w.ng + case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 1 else 0 end
  from walk w join sized s on s.row_idx = w.row_idx + 1
),
guard as (select count(*) <= 5000 as ok from customer),
batch as (select g, min(row_idx) as first_row, max(row_idx) as last_row, string_agg(line, chr(10) order by row_idx) as lines from walk join lines using (row_idx), guard where ok group by g)
"""


@query(_ROW_LINES)
def row_lines(spark: SparkSession, d: str) -> DataFrame:
    rows, heads = _customers(spark, d)
    return rows.join(heads.select(*sheets.KEY, "columns"), sheets.KEY).select("row_idx", t.serialize_row(F.col("columns"), F.col("cells")).alias("line"))


@query(f"with recursive {_ROW_BATCHES} select cast(g as integer) as batch, first_row, last_row, sha256(lines) as lines_hash from batch")
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    return sheets.batches(*_customers(spark, d)).select("batch", "first_row", "last_row", F.sha2("lines", 256).alias("lines_hash"))


_SUMMARY = """
head as (select 'Sheet: customer' || chr(10) || 'Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' || chr(10) || 'Rows: ' || (select count(*) from customer) || chr(10)
  || 'Dtypes: c_custkey=int64, c_name=object, c_nationkey=int64, c_acctbal=float64, c_mktsegment=object' || chr(10) || 'Sample:' || chr(10)
  || (select string_agg(line, chr(10) order by row_idx) from lines where row_idx < 3) as text),
parent as (select text, substr(sha256(concat_ws(chr(31), 'customer', 'customer', 'parent', '0', text)), 1, 16) as id from head)
"""


@query(
    f"""with recursive {_ROW_BATCHES}, {_SUMMARY}
    select id as chunk_id, null as parent_id, 'parent' as role, null as first_row, null as last_row, {_tokens("text")} as token_count, sha256(text) as text_hash, 0 as chunk_seq from parent
    union all
    select substr(sha256(concat_ws(chr(31), 'customer', 'customer', 'child', cast(g as varchar), x)), 1, 16), id, 'child', first_row, last_row, {_tokens("x")}, sha256(x), cast(g + 1 as integer)
    from (select *, 'Sheet: customer' || chr(10) || lines as x from batch) b, parent"""
)
def row_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sheets.chunks(*_customers(spark, d)).select(
        "chunk_id", "parent_id", "role", F.get("row_range", F.lit(0)).alias("first_row"), F.get("row_range", F.lit(1)).alias("last_row"), "token_count", F.sha2("text", 256).alias("text_hash"), "chunk_seq"
    )


# every row of tables of any size: cut into sheets that the guard lets through
_CUT = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
}
_PRICES = ("c_acctbal", "s_acctbal", "p_retailprice")


def _cut_sheets(spark: SparkSession, d: str, most: int = _CFG.max_rows_for_row_chunking) -> tuple[DataFrame, DataFrame]:
    parts = [
        sheets.cut(*sheets.from_table(table(spark, d, name), name, columns[0], {c: _money(c) if c in _PRICES else F.col(c) for c in columns}), most)
        for name, columns in _CUT.items()
    ]
    rows, heads = parts[0]
    for r, h in parts[1:]:
        rows, heads = rows.unionByName(r), heads.unionByName(h)
    return materialize(rows, "cut-rows"), materialize(heads, "cut-heads")  # each is read several times


def _cut_lines(name: str, columns: tuple[str, ...]) -> str:
    line = " || ' | ' || ".join(f"'{c}: ' || " + (f"cast({c} as decimal(18,2))" if c in _PRICES else c) for c in columns)
    return f"select '{name}' as doc_id, row_number() over (order by {columns[0]}) - 1 as i, {line} as line from {name}"


@query(
    f"""with recursive every as ({" union all ".join(_cut_lines(n, c) for n, c in _CUT.items())}),
    sized as (select doc_id || '-' || (i // 5000 + 1) as sheet_name, cast(i % 5000 as integer) as row_idx, line, {_tokens("line")} as n from every),
    walk as (
      select sheet_name, row_idx, 0 as g, case when n >= 400 then 0 else 1 end as k, case when n >= 400 then 0 else n end as tk, case when n >= 400 then 1 else 0 end as ng from sized where row_idx = 0
      union all
      select s.sheet_name, s.row_idx, w.ng, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.k + 1 end, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.tk + s.n end,
        w.ng + case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 1 else 0 end
      from walk w join sized s on s.sheet_name = w.sheet_name and s.row_idx = w.row_idx + 1
    )
    select sheet_name, cast(g as integer) as batch, min(row_idx) as first_row, max(row_idx) as last_row, sha256(string_agg(line, chr(10) order by row_idx)) as lines_hash
    from walk join sized using (sheet_name, row_idx) group by sheet_name, g"""
)
def cut_row_batches(spark: SparkSession, d: str) -> DataFrame:
    return sheets.batches(*_cut_sheets(spark, d)).select("sheet_name", "batch", "first_row", "last_row", F.sha2("lines", 256).alias("lines_hash"))


_CUT_TYPES = {"name": "object", "mktsegment": "object", "brand": "object", "type": "object", "acctbal": "float64", "retailprice": "float64"}


def _cut_head(name: str, columns: tuple[str, ...]) -> str:
    kinds = ", ".join(f"{c}={_CUT_TYPES.get(c.split('_')[1], 'int64')}" for c in columns)
    return f"select '{name}' as doc_id, '{', '.join(columns)}' as cols, '{kinds}' as kinds"


@query(
    f"""with recursive every as ({" union all ".join(_cut_lines(n, c) for n, c in _CUT.items())}), named as ({" union all ".join(_cut_head(n, c) for n, c in _CUT.items())}),
    sized as (select doc_id, cast(i // 5000 as integer) as sheet, doc_id || '-' || (i // 5000 + 1) as sheet_name, cast(i % 5000 as integer) as row_idx, line, {_tokens("line")} as n from every),
    walk as (
      select sheet_name, row_idx, 0 as g, case when n >= 400 then 0 else 1 end as k, case when n >= 400 then 0 else n end as tk, case when n >= 400 then 1 else 0 end as ng from sized where row_idx = 0
      union all
      select s.sheet_name, s.row_idx, w.ng, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.k + 1 end, case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 0 else w.tk + s.n end,
        w.ng + case when w.k + 1 >= 10 or w.tk + s.n >= 400 then 1 else 0 end
      from walk w join sized s on s.sheet_name = w.sheet_name and s.row_idx = w.row_idx + 1
    ),
    heads as (select doc_id, sheet, sheet_name, 'Sheet: ' || sheet_name || chr(10) || 'Columns: ' || any_value(cols) || chr(10) || 'Rows: ' || count(*) || chr(10) || 'Dtypes: ' || any_value(kinds) || chr(10)
      || 'Sample:' || chr(10) || string_agg(line, chr(10) order by row_idx) filter (row_idx < 3) as text from sized join named using (doc_id) group by doc_id, sheet, sheet_name),
    up as (select *, substr(sha256(concat_ws(chr(31), doc_id, sheet_name, 'parent', cast(row_number() over (partition by doc_id order by sheet) - 1 as varchar), text)), 1, 16) as id from heads),
    batch as (select doc_id, sheet, sheet_name, g, min(row_idx) as first_row, max(row_idx) as last_row, 'Sheet: ' || sheet_name || chr(10) || string_agg(line, chr(10) order by row_idx) as text
      from walk join sized using (sheet_name, row_idx) group by doc_id, sheet, sheet_name, g),
    down as (select b.*, row_number() over (partition by b.doc_id order by b.sheet, g) - 1 as o, id as parent_id from batch b join up using (sheet_name)),
    both_ as (select doc_id, sheet, -1 as g, id as chunk_id, cast(null as varchar) as parent_id, 'parent' as role, sheet_name, cast(null as integer) as first_row, cast(null as integer) as last_row, text from up
      union all select doc_id, sheet, g, substr(sha256(concat_ws(chr(31), doc_id, sheet_name, 'child', cast(o as varchar), text)), 1, 16), parent_id, 'child', sheet_name, first_row, last_row, text from down)
    select chunk_id, parent_id, role, sheet_name, first_row, last_row, {_tokens("text")} as token_count, sha256(text) as text_hash, cast(row_number() over (partition by doc_id order by sheet, g) - 1 as integer) as chunk_seq from both_"""
)
def cut_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sheets.chunks(*_cut_sheets(spark, d)).select(
        "chunk_id", "parent_id", "role", "sheet_name", F.get("row_range", F.lit(0)).alias("first_row"), F.get("row_range", F.lit(1)).alias("last_row"), "token_count", F.sha2("text", 256).alias("text_hash"), "chunk_seq"
    )


@query(
    " union all ".join(f"select '{n}' as sheet_name, cast(count(*) as integer) as row_count, count(*) > 5000 as guarded from {n}" for n in ("customer", "supplier", "part", "nation", "region", "orders"))
)
def row_guard(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"), ("orders", "o_orderkey")):
        one = sheets.profile(*sheets.from_table(table(spark, d, name), name, key, {key: F.col(key)})).select("sheet_name", "row_count", "guarded")
        out = one if out is None else out.unionByName(one)
    return out


def _grids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tabs = table(spark, d, "table_blocks").select("table_id", "table_rows").dropDuplicates(["table_id"])
    grid = tabs.select(F.col("table_id").alias("doc_id"), F.lit(0).alias("sheet_idx"), F.lit("table").alias("sheet_name"), F.posexplode("table_rows").alias("row_idx", "cells"))
    return sheets.from_grid(grid)


_NUMBER = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?(e[+-]?\d+(_\d+)*)?|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
_GRID = rf"""
tabs as (select table_id, any_value(table_rows) as r from table_blocks group by table_id),
clean as (select table_id, list_transform(r, lambda x: list_transform(coalesce(x, []), lambda c: coalesce({_strip("c")}, ''))) as r from tabs where len(r) > 0),
shape as (select table_id, r, list_max(list_transform(r, lambda x: len(x))) as w, r[1] as h from clean),
headed as (select *, case when len(h) > 0 then len(list_filter(h, lambda c: regexp_matches(c, '{_NUMBER}'))) / len(h) <= 0.5 else true end as has_header from shape),
grid as (select table_id, w, has_header, case when has_header then r[2:] else r end as body, case when has_header
    then list_transform(range(1, w + 1), lambda i: coalesce(nullif(h[i], ''), 'col_' || (i - 1))) else list_transform(range(w), lambda i: 'col_' || i) end as cols from headed),
cells as (select table_id, i, p, coalesce(body[i][p], '') as c from (select *, unnest(range(1, len(body) + 1)) as i from grid) g, (select unnest(range(1, 1001)) as p) q where p <= w)
"""


@query(
    f"""with {_GRID}, n as (select table_id, count(*) filter (c = '') as e, count(*) as a from cells group by table_id)
    select table_id, has_header, array_to_string(cols, chr(31)) as columns, cast(len(body) as integer) as row_count, coalesce(e / nullif(a, 0) > 0.4, false) as sparse_sheet from grid left join n using (table_id)"""
)
def sheet_profile(spark: SparkSession, d: str) -> DataFrame:
    rows, heads = _grids(spark, d)
    return sheets.profile(rows, heads).select(F.col("doc_id").alias("table_id"), "has_header", F.array_join("columns", t.SEPARATOR).alias("columns"), "row_count", "sparse_sheet")


@query(
    rf"""with {_GRID}, k as (select table_id, p, count(*) filter (c <> '') as n, bool_and(c = '' or regexp_matches(c, '^-*\d+$')) as ints, bool_and(c = '' or regexp_matches(c, '{_NUMBER}')) as nums from cells group by table_id, p),
    named as (select table_id, unnest(range(1, w + 1)) as p, unnest(cols) as c from grid)
    select table_id, cast(p - 1 as integer) as pos, c as "column", case when coalesce(n, 0) = 0 then 'empty' when ints then 'int64' when nums then 'float64' else 'object' end as dtype from named left join k using (table_id, p)"""
)
def sheet_dtypes(spark: SparkSession, d: str) -> DataFrame:
    return sheets.dtypes(*_grids(spark, d)).select(F.col("doc_id").alias("table_id"), "pos", "column", "dtype")


# --- structure ---------------------------------------------------------------------------------------


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").filter("heading is not null").select("doc_id", "sec_idx", "heading", F.coalesce("level", F.lit(1)).alias("level"), "page_start").distinct()


_HEADS = "heads as (select distinct doc_id, sec_idx, heading, coalesce(level, 1) as level, page_start from sections where heading is not null)"


@query(
    f"""with {_HEADS}, ends as (select a.doc_id, a.sec_idx, a.level, any_value(a.heading) as heading, min(b.sec_idx) as e from heads a left join heads b on a.doc_id = b.doc_id and b.sec_idx > a.sec_idx and b.level <= a.level group by all)
    select i.doc_id, i.sec_idx, string_agg({_strip("j.heading")}, ' > ' order by j.sec_idx) as path from heads i join ends j on i.doc_id = j.doc_id and j.sec_idx <= i.sec_idx and (j.e is null or j.e > i.sec_idx) group by all"""
)
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return sec.heading_paths(_headings(spark, d).withColumnRenamed("heading", "x").withColumnRenamed("level", "l")).select("doc_id", "sec_idx", F.array_join("section_path", t.PATH).alias("path"))


@query(
    f"""with {_HEADS}, f as (select doc_id, count(*) as headings, count(distinct page_start) as p from heads group by doc_id),
    e as (select d.doc_id, d.file_type, coalesce(headings, 0) as headings, case when coalesce(page_count, 0) > 0 then coalesce(p, 0) / page_count else 0 end as share from (select distinct doc_id, file_type, page_count from docs) d left join f using (doc_id))
    select doc_id, headings, round_even(share, 3) as heading_coverage, case when file_type = 'pptx' then 'SLIDE' when headings >= 2 and (file_type <> 'pdf' or share >= 0.6) then 'HEADING' when file_type = 'docx' then 'FLAT' else 'PAGE' end as parent_strategy from e"""
)
def strategy_ladder(spark: SparkSession, d: str) -> DataFrame:
    elements = _headings(spark, d).select("doc_id", F.lit("heading").alias("kind"), F.col("page_start").alias("page"))
    docs = table(spark, d, "docs").select("doc_id", "file_type", "page_count").distinct()
    return ladder.strategy(ladder.evidence(elements, docs)).select("doc_id", "headings", "heading_coverage", "parent_strategy")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as elements; markdown headings are headings."""
    none = F.lit(None)
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(t.split_lines(F.col("text"))).alias("seq", "raw")).filter("raw is not null")
    head = F.col("raw").rlike(r"^#{1,6}[ \t]+\S")
    return lines.select(
        "doc_id", "seq", F.when(head, "heading").otherwise("text").alias("kind"), F.when(head, F.regexp_replace("raw", r"^#{1,6}[ \t]+", "")).otherwise(F.col("raw")).alias("text"),
        none.cast("int").alias("page"), none.cast("int").alias("end_page"), F.when(head, F.length(F.regexp_extract("raw", "^(#+)", 1))).alias("level"), F.lit(False).alias("is_page_start"),
        none.cast("array<array<string>>").alias("table_rows"), none.cast("string").alias("table_markdown"), none.cast("string").alias("caption"),
    )


_LINES = rf"""
l0 as (select doc_id, string_split_regex(text, '\r\n|[\n\x{{0b}}\x{{0c}}\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') as x from documents where text is not null),
l1 as (select doc_id, unnest(case when x[-1] = '' then x[:-2] else x end) as raw, generate_subscripts(case when x[-1] = '' then x[:-2] else x end, 1) - 1 as seq from l0),
l2 as (select *, regexp_matches(raw, '^#{{1,6}}[ \t]+\S') as head from l1),
l as (select *, length(regexp_extract(raw, '^(#+)', 1)) as level, {_strip("regexp_replace(raw, '^#{1,6}[ \\t]+', '')")} as x, cast(sum(cast(head as integer)) over (partition by doc_id order by seq) as integer) as sec_idx from l2)
"""


@query(
    f"""with {_LINES}, hs as (select doc_id, sec_idx, level, x from l where head),
    ends as (select a.doc_id, a.sec_idx, a.level, any_value(a.x) as x, min(b.sec_idx) as e from hs a left join hs b on a.doc_id = b.doc_id and b.sec_idx > a.sec_idx and b.level <= a.level group by all),
    path as (select i.doc_id, i.sec_idx, any_value(i.x) as heading, any_value(i.level) as level, string_agg(j.x, ' > ' order by j.sec_idx) as path from hs i join ends j on i.doc_id = j.doc_id and j.sec_idx <= i.sec_idx and (j.e is null or j.e > i.sec_idx) group by i.doc_id, i.sec_idx),
    b as (select doc_id, sec_idx, count(*) as blocks from l where not head and {_strip("raw")} <> '' group by all),
    root as (select doc_id, 0 as sec_idx, null as heading, 0 as level, '' as path from l group by doc_id having not bool_or(head) or bool_or(sec_idx = 0 and {_strip("raw")} <> ''))
    select s.*, coalesce(blocks, 0) as blocks from (select doc_id, sec_idx, heading, cast(level as integer) as level, path from path union all select * from root) s left join b using (doc_id, sec_idx)"""
)
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = sec.by_headings(_lines(spark, d))
    blocks = parts.blocks.groupBy("doc_id", "sec_idx").agg(F.count(F.lit(1)).alias("blocks"))
    return parts.sections.join(blocks, ["doc_id", "sec_idx"], "left").select("doc_id", "sec_idx", "heading", "level", F.array_join("section_path", t.PATH).alias("path"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query(
    f"""with {_HEADS}, f as (select doc_id, count(distinct page_start) as p from heads group by doc_id)
    select doc_id, case when coalesce(page_count, 0) > 0 then coalesce(p, 0) / page_count else 1.0 end as coverage from (select distinct doc_id, page_count from docs) d left join f using (doc_id)"""
)
def section_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select("doc_id", "page_count").distinct()
    return ladder.section_coverage(_headings(spark, d), docs)


@query(
    """with b as (select distinct on (block_id) block_id, doc_id, page, sec_idx, block_order from blocks)
    select block_id, page is not null and row_number() over (partition by doc_id, page order by sec_idx, block_order, block_id) = 1 as is_page_start from b"""
)
def page_starts(spark: SparkSession, d: str) -> DataFrame:
    from foliospark.sources import files

    blocks = table(spark, d, "blocks").dropDuplicates(["block_id"])
    items = blocks.select("block_id", "doc_id", "page", F.lit("text").alias("kind"), F.lit(False).alias("is_page_start"), F.struct("sec_idx", "block_order", "block_id").alias("seq"))
    return files.with_page_starts(items).select("block_id", "is_page_start")


_PAGES = f"""
b as (select distinct block_id, doc_id, coalesce(page, 1) as page, text from blocks),
bp as (select doc_id, page, sum({_tokens("text")}) as n from b where {_strip("text")} <> '' group by all),
tp as (select distinct doc_id, coalesce(page, 1) as page, true as tb from table_blocks),
pg as (select coalesce(bp.doc_id, tp.doc_id) as doc_id, coalesce(bp.page, tp.page) as page, cast(coalesce(n, 0) as bigint) as n, coalesce(tb, false) as tb from bp full join tp on bp.doc_id = tp.doc_id and bp.page = tp.page),
idx as (select *, row_number() over (partition by doc_id order by page) as i from pg)
"""


@query(
    f"""with recursive {_PAGES}, walk as (
      select doc_id, i, page, 0 as g, case when n < 100 and not tb then n else 0 end as tk, case when n < 100 and not tb then 0 else 1 end as ng from idx where i = 1
      union all
      select x.doc_id, x.i, x.page, w.ng, case when w.tk + x.n < 100 and not x.tb then w.tk + x.n else 0 end, w.ng + case when w.tk + x.n < 100 and not x.tb then 0 else 1 end from walk w join idx x on x.doc_id = w.doc_id and x.i = w.i + 1
    ) select doc_id, cast(g as integer) as sec_idx, min(page) as page_start, max(page) as page_end from walk group by all"""
)
def short_page_carry(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").dropDuplicates(["block_id"]).select("doc_id", F.lit("text").alias("kind"), "text", "page", F.struct("sec_idx", "block_order", "block_id").alias("_o"))
    none = F.lit(None)
    tabs = table(spark, d, "table_blocks").dropDuplicates(["table_id"]).select("doc_id", F.lit("table").alias("kind"), none.cast("string").alias("text"), "page", F.struct("sec_idx", F.col("tbl_seq").alias("block_order"), F.col("table_id").alias("block_id")).alias("_o"))
    every = blocks.unionByName(tabs).withColumnRenamed("_o", "seq")
    elements = every.select("doc_id", "seq", "kind", "text", "page", none.cast("int").alias("end_page"), none.cast("int").alias("level"), none.cast("array<array<string>>").alias("table_rows"), none.cast("string").alias("table_markdown"), none.cast("string").alias("caption"))
    return sec.by_pages(elements).sections.select("doc_id", "sec_idx", "page_start", "page_end")


@query(
    rf"""with l as (select doc_id, unnest(x) as raw, generate_subscripts(x, 1) - 1 as line from (select doc_id, string_split_regex(text, '\r\n|[\n\x{{0b}}\x{{0c}}\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') as x from documents where text is not null)),
    s as (select doc_id, line, {_strip("raw")} as text from l where {_strip("raw")} <> ''),
    n as (select *, coalesce(lag(text) over w, '') as before, coalesce(lead(text) over w, '') as after from s window w as (partition by doc_id order by line)),
    k as (select * from n where length(text) <= 120 and (not regexp_matches(text, '[.!?:;,]$') or regexp_matches(text, '^\d+(\.\d+)*\s')))
    select doc_id, 'L' || (row_number() over (partition by doc_id order by line) - 1) as line_id, cast(line as integer) as line, text, before, after from k"""
)
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    elements = table(spark, d, "documents").select("doc_id", F.lit(0).alias("seq"), F.lit("text").alias("kind"), "text", none.cast("int").alias("page"), F.lit(False).alias("is_page_start"))
    return ladder.candidates(elements).select("doc_id", "line_id", "line", "text", "before", "after")


@query(
    """with c as (select doc_id, sum(length(text)) as n from (select distinct block_id, doc_id, text from blocks) group by doc_id)
    select d.doc_id, cast(coalesce(n, 0) as bigint) as chars, file_type = 'pdf' and coalesce(n, 0) / greatest(coalesce(page_count, 0), 1) < 50 as low from (select distinct doc_id, file_type, page_count from docs) d left join c using (doc_id)"""
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    elements = table(spark, d, "blocks").select("block_id", "doc_id", F.lit("text").alias("kind"), "text").dropDuplicates(["block_id"])
    docs = table(spark, d, "docs").select("doc_id", "file_type", "page_count").distinct().withColumn("error", F.lit(None).cast("string"))
    chars = elements.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    return ladder.quality_gate(elements, docs).join(chars, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), F.col("error").isNotNull().alias("low"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Headings, blocks and tables of the sections as a stream of elements."""
    none = F.lit(None)
    shape = lambda df, kind, text, page, order: df.select(
        "doc_id", order.alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), page.cast("int").alias("page"), none.cast("int").alias("level"), none.cast("array<array<string>>").alias("table_rows"),
        none.cast("string").alias("table_markdown"), none.cast("string").alias("caption"), "sec_idx",
    )
    order = lambda kind, at, key: F.struct(F.col("sec_idx"), F.lit(kind).alias("k"), F.col(at).alias("o"), F.col(key).alias("i"))
    heads = shape(table(spark, d, "sections").dropDuplicates(["section_id"]).filter("heading is not null"), "heading", F.col("heading"), F.col("page_start"), order(0, "sec_idx", "section_id"))
    said = shape(table(spark, d, "blocks").dropDuplicates(["block_id"]), "text", F.col("text"), F.col("page"), order(1, "block_order", "block_id"))
    tabs = shape(table(spark, d, "table_blocks").dropDuplicates(["table_id"]), "table", none.cast("string"), F.col("page"), order(2, "tbl_seq", "table_id"))
    return heads.unionByName(said).unionByName(tabs)


@query(
    f"""with e as (select doc_id, heading as text, page_start as page, sec_idx, 0 as k, sec_idx as o, section_id as i from (select distinct on (section_id) * from sections) where heading is not null
      union all select doc_id, text, page, sec_idx, 1, block_order, block_id from (select distinct on (block_id) * from blocks)),
    b as (select * from e where {_strip("coalesce(text, '')")} <> ''),
    d as (select doc_id from e union select doc_id from table_blocks)
    select d.doc_id, d.doc_id || '-sec-0' as section_id, cast(arg_min(page, (sec_idx, k, o, i)) as integer) as page_start, cast(arg_max(page, (sec_idx, k, o, i)) filter (page is not null) as integer) as page_end, count(b.doc_id) as blocks
    from d left join b using (doc_id) group by d.doc_id"""
)
def flat_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = sec.flat(_elements(spark, d).drop("sec_idx"))
    blocks = parts.blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))
    return parts.sections.join(blocks, "doc_id", "left").select("doc_id", "section_id", "page_start", "page_end", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query(
    f"""with decks as (select doc_id, max(num_slides) as num_slides from docs where file_type = 'pptx' group by doc_id),
    e as (select doc_id, heading as text, 0 as k, sec_idx, sec_idx as o, section_id as i from (select distinct on (section_id) * from sections) where heading is not null
      union all select doc_id, text, 1, sec_idx, block_order, block_id from (select distinct on (block_id) * from blocks)),
    b as (select e.*, {_strip("coalesce(text, '')")} as x from e join decks using (doc_id)),
    n as (select doc_id, greatest(coalesce(num_slides, 0), coalesce(m, 0)) as n from decks left join (select doc_id, max(sec_idx) + 1 as m from (select doc_id, sec_idx from b union all select doc_id, sec_idx from table_blocks) group by doc_id) using (doc_id)),
    s as (select doc_id, unnest(range(n)) as sec_idx from n),
    t as (select doc_id, sec_idx, arg_min(x, (k, o, i)) as heading from b where x <> '' group by all),
    c as (select b.doc_id, b.sec_idx, count(*) as blocks from b left join t using (doc_id, sec_idx) where x <> '' and not (k = 0 and x = coalesce(heading, '')) group by all)
    select doc_id, cast(sec_idx as integer) as sec_idx, heading, coalesce(heading, 'Slide ' || (sec_idx + 1)) as path, coalesce(blocks, 0) as blocks from s left join t using (doc_id, sec_idx) left join c using (doc_id, sec_idx)"""
)
def slide_sections(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "docs").filter("file_type = 'pptx'").groupBy("doc_id").agg(F.max("num_slides").alias("num_slides"))
    elements = _elements(spark, d).join(decks.select("doc_id"), "doc_id", "left_semi")
    parts = sec.by_slides(elements.withColumn("page", F.col("sec_idx") + 1).drop("sec_idx"), decks)
    blocks = parts.blocks.groupBy("doc_id", "sec_idx").agg(F.count(F.lit(1)).alias("blocks"))
    return parts.sections.join(blocks, ["doc_id", "sec_idx"], "left").select("doc_id", "sec_idx", "heading", F.array_join("section_path", t.PATH).alias("path"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def _numbered_headings(payload: Column) -> Column:
    """A classifier by rule: numbered lines are headings, as deep as their numbers."""
    lines = F.from_json(payload, "array<struct<line_id:string,text:string>>")
    number = lambda x: F.regexp_extract(x["text"], r"^(\d+(\.\d+)*)\s", 1)
    said = F.transform(F.filter(lines, lambda x: number(x) != ""), lambda x: F.struct(x["line_id"].alias("line_id"), F.lit(True).alias("is_heading"), (F.regexp_count(number(x), F.lit(r"\.")) + 1).cast("string").alias("level")))
    return F.to_json(said)


@query(
    rf"""with l0 as (select doc_id, string_split_regex(text, '\r\n|[\n\x{{0b}}\x{{0c}}\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') as x from documents where text is not null),
    l1 as (select doc_id, unnest(case when x[-1] = '' then x[:-2] else x end) as raw, generate_subscripts(case when x[-1] = '' then x[:-2] else x end, 1) - 1 as seq from l0),
    k as (select doc_id, seq, {_strip("raw")} as x from l1 where {_strip("raw")} <> '' and length({_strip("raw")}) <= 120 and (not regexp_matches({_strip("raw")}, '[.!?:;,]$') or regexp_matches({_strip("raw")}, '^\d+(\.\d+)*\s'))),
    few as (select doc_id from k group by doc_id having count(*) <= 500),
    hd as (select doc_id, seq, least(4, length(n) - length(replace(n, '.', '')) + 1) as level from (select k.*, regexp_extract(x, '^(\d+(\.\d+)*)\s', 1) as n from k join few using (doc_id)) where n <> ''),
    l as (select l1.*, {_strip("raw")} as x, hd.level, hd.level is not null as head, cast(sum(cast(hd.level is not null as integer)) over (partition by l1.doc_id order by l1.seq) as integer) as sec_idx from l1 left join hd using (doc_id, seq)),
    hs as (select doc_id, sec_idx, level, x from l where head),
    ends as (select a.doc_id, a.sec_idx, a.level, any_value(a.x) as x, min(b.sec_idx) as e from hs a left join hs b on a.doc_id = b.doc_id and b.sec_idx > a.sec_idx and b.level <= a.level group by all),
    path as (select i.doc_id, i.sec_idx, any_value(i.level) as level, string_agg(j.x, ' > ' order by j.sec_idx) as path from hs i join ends j on i.doc_id = j.doc_id and j.sec_idx <= i.sec_idx and (j.e is null or j.e > i.sec_idx) group by i.doc_id, i.sec_idx),
    root as (select doc_id, 0 as sec_idx, 0 as level, '' as path from l group by doc_id having not bool_or(head) or bool_or(sec_idx = 0 and x <> ''))
    select doc_id, sec_idx, cast(level as integer) as level, path from path union all select doc_id, sec_idx, level, path from root"""
)
def inferred_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by headings that a classifier confirms among the candidate lines of documents."""
    none = F.lit(None)
    elements = table(spark, d, "documents").filter("text is not null").select(
        "doc_id", F.lit(0).alias("seq"), F.lit("text").alias("kind"), "text", none.cast("int").alias("page"), none.cast("int").alias("end_page"), none.cast("int").alias("level"), F.lit(False).alias("is_page_start"),
        none.cast("array<array<string>>").alias("table_rows"), none.cast("string").alias("table_markdown"), none.cast("string").alias("caption"),
    )
    heads = materialize(ladder.confirmed(ladder.candidates(elements), _numbered_headings), "confirmed-headings")
    return sec.by_headings(ladder.promoted(elements, heads)).sections.select("doc_id", "sec_idx", "level", F.array_join("section_path", t.PATH).alias("path"))


# --- packers -----------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").dropDuplicates(["block_id"])


@query(
    f"""with recursive b as (select distinct block_id, doc_id, sec_idx, block_order, seq, text from blocks where {_strip("text")} <> ''),
    j as (select doc_id, sec_idx, string_agg(text, chr(10) || chr(10) order by block_order, seq, text) as text from b group by all),
    p as (select doc_id, sec_idx, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")} <> '') as ps from j),
    u as (select doc_id, sec_idx, unnest(ps) as para, generate_subscripts(ps, 1) as i from p),
    s as (select *, {_tokens("para")} as n from u),
    walk as (select doc_id, sec_idx, i, para, 0 as g, cast(n as bigint) as tk from s where i = 1
      union all select s.doc_id, s.sec_idx, s.i, s.para, case when w.tk + s.n <= 3000 then w.g else w.g + 1 end, case when w.tk + s.n <= 3000 then w.tk + s.n else s.n end
      from walk w join s on s.doc_id = w.doc_id and s.sec_idx = w.sec_idx and s.i = w.i + 1)
    select doc_id, sec_idx, cast(g as integer) as part, cast(max(g) over (partition by doc_id, sec_idx) + 1 as integer) as parts, sha256(text) as text_hash
    from (select doc_id, sec_idx, g, string_agg(para, chr(10) || chr(10) order by i) as text from walk group by all)"""
)
def paragraph_parents(spark: SparkSession, d: str) -> DataFrame:
    return prose.paragraph_parts(prose.section_texts(_blocks(spark, d))).select("doc_id", "sec_idx", "part", "parts", F.sha2("text", 256).alias("text_hash"))


@query(
    f"""with recursive b as (select distinct block_id, doc_id, sec_idx, block_order, seq, text from blocks where {_strip("text")} <> ''),
    j as (select doc_id, sec_idx, string_agg(text, chr(10) || chr(10) order by block_order, seq, text) as text from b group by all),
    p as (select doc_id, sec_idx, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")} <> '') as ps from j),
    u as (select doc_id, sec_idx, unnest(ps) as para, generate_subscripts(ps, 1) as i from p), s as (select *, {_tokens("para")} as n from u),
    walk as (select doc_id, sec_idx, i, para, 0 as g, cast(n as bigint) as tk from s where i = 1
      union all select s.doc_id, s.sec_idx, s.i, s.para, case when w.tk + s.n <= 3000 then w.g else w.g + 1 end, case when w.tk + s.n <= 3000 then w.tk + s.n else s.n end
      from walk w join s on s.doc_id = w.doc_id and s.sec_idx = w.sec_idx and s.i = w.i + 1),
    parts as (select doc_id, sec_idx, g, string_agg(para, chr(10) || chr(10) order by i) as text from walk group by all),
    k as (select *, max(g) over (partition by doc_id, sec_idx) + 1 as m, row_number() over (partition by doc_id order by sec_idx, g) - 1 as ordinal from parts),
    q as (select k.*, s.section_path as sp, ' (part ' || (g + 1) || '/' || m || ')' as mark from k join (select distinct on (section_id) doc_id, sec_idx, section_path from sections) s using (doc_id, sec_idx)),
    f as (select *, case when m = 1 then array_to_string(sp, ' > ') when len(sp) > 0 then array_to_string(sp, ' > ') || mark else trim(mark) end as path from q)
    select doc_id, cast(ordinal as integer) as ordinal, path, substr(sha256(concat_ws(chr(31), doc_id, path, 'parent', cast(ordinal as varchar), text)), 1, 16) as chunk_id, {_tokens("text")} as token_count from f"""
)
def prose_parents(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "sections").dropDuplicates(["section_id"])
    return prose.parents(sections, _blocks(spark, d)).select("doc_id", "ordinal", F.array_join("section_path", t.PATH).alias("path"), "chunk_id", "token_count")


@query(
    rf"""with recursive s0 as (select doc_id, string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(30), 'g'), chr(30)) as x from documents where text is not null),
    s1 as (select doc_id, list_filter(x, lambda y: {_strip("y")} <> '') as x from s0), s2 as (select doc_id, unnest(x) as p, generate_subscripts(x, 1) as i from s1), s as (select *, {_tokens("p")} as n from s2),
    walk as (select doc_id, i, p, 0 as g, cast(n as bigint) as tk from s where i = 1
      union all select s.doc_id, s.i, s.p, case when w.tk < 100 then w.g else w.g + 1 end, case when w.tk < 100 then w.tk + s.n else s.n end from walk w join s on s.doc_id = w.doc_id and s.i = w.i + 1),
    tail as (select doc_id, max(g) as lg, arg_max(tk, i) as lt from walk group by doc_id)
    select doc_id, cast(least(g, case when lg > 0 and lt < 100 then lg - 1 else lg end) as integer) as at, sha256(string_agg(p, chr(10) order by i)) as text_hash from walk join tail using (doc_id) group by all"""
)
def small_merge(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(prose.sentences(F.col("text"))).alias("at", "text"))
    return prose.merge_pieces(pieces, ["doc_id"], _CFG.min_child_tokens).select("doc_id", "at", F.sha2("text", 256).alias("text_hash"))


def _cell(c: str) -> str:
    return _strip(f"replace(replace(coalesce({c}, ''), '|', '\\|'), chr(10), ' ')")


_MARKDOWN = f"""
tabs as (select distinct on (table_id) table_id, table_rows as r, caption, markdown, doc_id, sec_idx, tbl_seq, page from table_blocks),
wide as (select *, coalesce(list_max(list_transform(r, lambda x: len(coalesce(x, [])))), 0) as w from tabs),
lined as (select *, list_transform(r, lambda x: '| ' || array_to_string(list_transform(range(1, w + 1), lambda i: {_cell("x[i]")}), ' | ') || ' |') as ls,
  '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' as rule from wide),
marked as (select *, case when len(r) > 0 and w > 0 then array_to_string(list_concat([ls[1], rule], ls[2:]), chr(10)) else '' end as md from lined)
"""


@query(f"with {_MARKDOWN} select table_id, md from marked")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "table_blocks").dropDuplicates(["table_id"]).select("table_id", t.grid_to_markdown(F.col("table_rows")).alias("md"))


@query(
    f"""with recursive {_MARKDOWN}, own as (select *, coalesce(nullif(markdown, ''), md) as m, case when coalesce(caption, '') = '' then '' else caption || chr(10) end as cap from marked),
    fit as (select *, {_tokens("cap || m")} <= 800 or coalesce(len(r), 0) = 0 as fits from own),
    it as (select table_id, cap, ls[1] as h, rule, 800 - ({_tokens("ls[1]")} + 2 * w + 1) as room, unnest(ls[2:]) as l, generate_subscripts(ls[2:], 1) as i from fit where not fits),
    s as (select *, {_tokens("l")} as n from it),
    walk as (select table_id, i, l, 0 as g, cast(n as bigint) as tk from s where i = 1
      union all select s.table_id, s.i, s.l, case when w.tk + s.n <= s.room then w.g else w.g + 1 end, case when w.tk + s.n <= s.room then w.tk + s.n else s.n end from walk w join s on s.table_id = w.table_id and s.i = w.i + 1),
    parts as (select table_id, g, string_agg(l, chr(10) order by i) as body from walk group by all)
    select table_id, 0 as part, 1 as parts, sha256(cap || m) as text_hash from fit where fits
    union all select p.table_id, cast(g as integer), cast(max(g) over (partition by p.table_id) + 1 as integer), sha256(cap || h || chr(10) || rule || chr(10) || body)
    from parts p join (select distinct table_id, cap, h, rule from it) using (table_id)"""
)
def table_splits(spark: SparkSession, d: str) -> DataFrame:
    tabs = table(spark, d, "table_blocks").dropDuplicates(["table_id"]).withColumnRenamed("table_rows", "rows")
    return prose.table_pieces(tabs).select("table_id", "part", "parts", F.sha2("text", 256).alias("text_hash"))


@query(
    f"""with recursive {_MARKDOWN}, own as (select *, coalesce(nullif(markdown, ''), md) as m, case when coalesce(caption, '') = '' then '' else caption || chr(10) end as cap from marked join (select distinct doc_id from docs) using (doc_id)),
    fit as (select *, {_tokens("cap || m")} <= 800 or coalesce(len(r), 0) = 0 as fits from own),
    it as (select table_id, cap, ls[1] as h, rule, 800 - ({_tokens("ls[1]")} + 2 * w + 1) as room, unnest(ls[2:]) as l, generate_subscripts(ls[2:], 1) as i from fit where not fits),
    s as (select *, {_tokens("l")} as n from it),
    walk as (select table_id, i, l, 0 as g, cast(n as bigint) as tk from s where i = 1
      union all select s.table_id, s.i, s.l, case when w.tk + s.n <= s.room then w.g else w.g + 1 end, case when w.tk + s.n <= s.room then w.tk + s.n else s.n end from walk w join s on s.table_id = w.table_id and s.i = w.i + 1),
    parts as (select table_id, g, string_agg(l, chr(10) order by i) as body from walk group by all),
    piece as (select table_id, 0 as part, 1 as parts, false as split, cap || m as text from fit where fits
      union all select p.table_id, g, max(g) over (partition by p.table_id) + 1, true, cap || h || chr(10) || rule || chr(10) || body from parts p join (select distinct table_id, cap, h, rule from it) using (table_id)),
    placed as (select o.doc_id, piece.*, cast(row_number() over (partition by o.doc_id order by o.sec_idx, o.tbl_seq, part) - 1 as integer) as ordinal from piece join own o using (table_id)),
    root as (select doc_id, coalesce(nullif(any_value(title), ''), doc_id) as text, substr(sha256(concat_ws(chr(31), doc_id, '', 'parent', '-1', 'document-root')), 1, 16) as root_id from (select distinct doc_id, title from docs) group by doc_id)
    select doc_id, 'parent' as role, root_id as chunk_id, null as parent_id, 0 as chunk_seq, sha256(text) as text_hash from root where doc_id in (select doc_id from placed)
    union all select doc_id, 'child', substr(sha256(concat_ws(chr(31), doc_id, case when split then '(table part ' || (part + 1) || '/' || parts || ')' else '' end, 'child', cast(ordinal as varchar), p.text)), 1, 16), root_id, ordinal + 1, sha256(p.text)
    from placed p join root using (doc_id)"""
)
def table_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every table below a synthetic root of its document."""
    docs = table(spark, d, "docs").select("doc_id", "title").dropDuplicates(["doc_id"])
    tabs = table(spark, d, "table_blocks").dropDuplicates(["table_id"]).withColumnRenamed("table_rows", "rows").drop("section_path")
    return prose.tables_only(docs, tabs).select("doc_id", "role", "chunk_id", "parent_id", "chunk_seq", F.sha2("text", 256).alias("text_hash"))


def _split_level(source: str, part: str, glue: str, name: str, limit: int) -> str:
    """SQL of one level of the recursive split: ``source(doc_id, path, text)``, pieces of at most ``limit``
    tokens of neighbours packed together, as ``name(doc_id, path, text, small)``."""
    return f"""
{name}_u as (select doc_id, path, unnest({part}) as p, generate_subscripts({part}, 1) as j from {source}),
{name}_s as (select doc_id, path, p, {_tokens("p")} as n, row_number() over (partition by doc_id, path order by j) as i from {name}_u where {_strip("p")} <> ''),
{name}_w as (select doc_id, path, i, p, 0 as g, cast(n as bigint) as tk from {name}_s where i = 1
  union all select s.doc_id, s.path, s.i, s.p, case when w.tk > 0 and w.tk + s.n <= {limit} then w.g else w.g + 1 end, case when w.tk > 0 and w.tk + s.n <= {limit} then w.tk + s.n else s.n end
  from {name}_w w join {name}_s s on s.doc_id = w.doc_id and s.path = w.path and s.i = w.i + 1),
{name} as (select doc_id, path || lpad(cast(g as varchar), 6, '0') as path, string_agg(p, {glue} order by i) as text, sum({_tokens("p")}) <= {limit} as small from {name}_w group by doc_id, path, g)"""


_RECURSIVE = 120


@query(
    f"""with recursive whole as (select doc_id, '' as path, text, {_tokens("text")} <= {_RECURSIVE} as small from documents where text is not null),
    big0 as (select * from whole where not small), {_split_level("big0", "string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", "a", _RECURSIVE)},
    big1 as (select * from a where not small), {_split_level("big1", "string_split(text, chr(10))", "chr(10)", "b", _RECURSIVE)},
    big2 as (select * from b where not small), {_split_level("big2", "string_split_regex(text, '[ \t\n\x0b\f\r]+')", "' '", "c", _RECURSIVE)},
    every as (select doc_id, path, text from whole where small union all select doc_id, path, text from a where small union all select doc_id, path, text from b where small union all select doc_id, path, text from c)
    select doc_id, cast(row_number() over (partition by doc_id order by path) - 1 as integer) as piece, sha256(text) as text_hash from every"""
)
def recursive_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at blank lines, lines and blanks into pieces of 120 tokens."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(prose.recursive_split(F.col("text"), _RECURSIVE)).alias("piece", "text"))
    return docs.select("doc_id", "piece", F.sha2("text", 256).alias("text_hash"))


# the whole prose chunker: parents, their pieces by sentences and size, tables below them or a synthetic root
_PROSE_CHUNKS = f"""
dd as (select doc_id, any_value(title) as title from docs where file_type in ('pdf', 'docx') group by doc_id),
sc as (select distinct on (section_id) doc_id, sec_idx, section_path as sp, page_start from sections where doc_id in (select doc_id from dd)),
bl as (select distinct block_id, doc_id, sec_idx, block_order, seq, text from blocks where doc_id in (select doc_id from dd) and {_strip("text")} <> ''),
jo as (select doc_id, sec_idx, string_agg(text, chr(10) || chr(10) order by block_order, seq, text) as text from bl group by all),
pp as (select doc_id, sec_idx, list_filter(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")} <> '') as ps from jo),
pu as (select doc_id, sec_idx, unnest(ps) as para, generate_subscripts(ps, 1) as i from pp), ps as (select *, {_tokens("para")} as n from pu),
pw as (select doc_id, sec_idx, i, para, 0 as g, cast(n as bigint) as tk from ps where i = 1
  union all select s.doc_id, s.sec_idx, s.i, s.para, case when w.tk + s.n <= 3000 then w.g else w.g + 1 end, case when w.tk + s.n <= 3000 then w.tk + s.n else s.n end
  from pw w join ps s on s.doc_id = w.doc_id and s.sec_idx = w.sec_idx and s.i = w.i + 1),
pa as (select doc_id, sec_idx, g, string_agg(para, chr(10) || chr(10) order by i) as text from pw group by all),
pk as (select *, max(g) over (partition by doc_id, sec_idx) + 1 as m from pa join sc using (doc_id, sec_idx)),
pq as (select *, row_number() over (partition by doc_id order by sec_idx, g) - 1 as ordinal, '(part ' || (g + 1) || '/' || m || ')' as mark from pk),
pf as (select *, case when m = 1 then coalesce(array_to_string(sp, ' > '), '') when len(sp) > 0 then array_to_string(sp, ' > ') || ' ' || mark else mark end as path from pq),
up as (select *, substr(sha256(concat_ws(chr(31), doc_id, path, 'parent', cast(ordinal as varchar), text)), 1, 16) as chunk_id, {_tokens("text")} as n from pf),
se as (select chunk_id as pid, unnest(x) as text, generate_subscripts(x, 1) as pos from (select chunk_id, string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(30), 'g'), chr(30)) as x from up where n >= 100)),
whole as (select pid || ':' || lpad(cast(pos as varchar), 6, '0') as doc_id, '' as path, text, {_tokens("text")} <= 800 as small from se),
big0 as (select * from whole where not small), {_split_level("big0", "string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)", "a", 800)},
big1 as (select * from a where not small), {_split_level("big1", "string_split(text, chr(10))", "chr(10)", "b", 800)},
big2 as (select * from b where not small), {_split_level("big2", "string_split_regex(text, '[ \t\n\x0b\f\r]+')", "' '", "c", 800)},
cut as (select doc_id || path as o, text from whole where small union all select doc_id || path, text from a where small union all select doc_id || path, text from b where small union all select doc_id || path, text from c),
ms as (select split_part(o, ':', 1) as pid, row_number() over (partition by split_part(o, ':', 1) order by o) as i, text, {_tokens("text")} as n from cut where {_strip("text")} <> ''),
mw as (select pid, i, text, 0 as g, cast(n as bigint) as tk from ms where i = 1
  union all select s.pid, s.i, s.text, case when w.tk < 100 then w.g else w.g + 1 end, case when w.tk < 100 then w.tk + s.n else s.n end from mw w join ms s on s.pid = w.pid and s.i = w.i + 1),
mt as (select pid, max(g) as lg, arg_max(tk, i) as lt from mw group by pid),
me as (select pid, least(g, case when lg > 0 and lt < 100 then lg - 1 else lg end) as k, string_agg(text, chr(10) order by i) as text from mw join mt using (pid) group by all),
pi as (select chunk_id as pid, 0 as k, text from up where n < 100 union all select pid, k, text from me),
tx as (select u.doc_id, u.sec_idx, false as tab, u.g as a, row_number() over (partition by pid order by k) as b, pid as parent_id, path, pi.text from pi join up u on u.chunk_id = pi.pid),
{_MARKDOWN},
tw as (select *, coalesce(nullif(markdown, ''), md) as m, case when coalesce(caption, '') = '' then '' else caption || chr(10) end as cap from marked where doc_id in (select doc_id from dd)),
fit as (select *, {_tokens("cap || m")} <= 800 or coalesce(len(r), 0) = 0 as fits from tw),
it as (select table_id, cap, ls[1] as h, rule, 800 - ({_tokens("ls[1]")} + 2 * w + 1) as room, unnest(ls[2:]) as l, generate_subscripts(ls[2:], 1) as i from fit where not fits),
ts as (select *, {_tokens("l")} as n from it),
tk as (select table_id, i, l, 0 as g, cast(n as bigint) as tk from ts where i = 1
  union all select s.table_id, s.i, s.l, case when w.tk + s.n <= s.room then w.g else w.g + 1 end, case when w.tk + s.n <= s.room then w.tk + s.n else s.n end from tk w join ts s on s.table_id = w.table_id and s.i = w.i + 1),
tp as (select table_id, g, string_agg(l, chr(10) order by i) as body from tk group by all),
pc as (select table_id, 0 as part, 1 as parts, false as split, cap || m as text from fit where fits
  union all select p.table_id, g, max(g) over (partition by p.table_id) + 1, true, cap || h || chr(10) || rule || chr(10) || body from tp p join (select distinct table_id, cap, h, rule from it) using (table_id)),
rt as (select doc_id, coalesce(nullif(title, ''), doc_id) as text, substr(sha256(concat_ws(chr(31), doc_id, '', 'parent', '-1', 'document-root')), 1, 16) as root_id from dd),
tt as (select t.doc_id, t.sec_idx, true as tab, t.tbl_seq as a, pc.part as b, coalesce(u.chunk_id, rt.root_id) as parent_id,
  case when split then array_to_string(list_append(coalesce(sc.sp, []), '(table part ' || (part + 1) || '/' || parts || ')'), ' > ') else coalesce(array_to_string(sc.sp, ' > '), '') end as path, pc.text
  from pc join tw t using (table_id) join rt using (doc_id) left join up u on u.doc_id = t.doc_id and u.sec_idx = t.sec_idx and u.g = 0 left join sc on sc.doc_id = t.doc_id and sc.sec_idx = t.sec_idx),
ro as (select * from rt where root_id in (select parent_id from tt)),
dn as (select *, row_number() over (partition by doc_id order by sec_idx nulls last, tab, a, b) - 1 as ordinal from (select * from tx union all select * from tt)),
n1 as (select doc_id, count(*) as n from up group by doc_id)
"""


_PROSE_ROWS = """
    select doc_id, 'parent' as role, 'text' as block_type, root_id as chunk_id, null as parent_id, cast(0 as integer) as chunk_seq, sha256(text) as text_hash from ro
    union all select doc_id, 'parent', 'text', chunk_id, null, cast(ordinal + (doc_id in (select doc_id from ro))::integer as integer), sha256(text) from up
    union all select doc_id, 'child', case when tab then 'table' else 'text' end, substr(sha256(concat_ws(chr(31), doc_id, path, 'child', cast(ordinal as varchar), text)), 1, 16), parent_id,
      cast(ordinal + (doc_id in (select doc_id from ro))::integer + coalesce(n1.n, 0) as integer), sha256(text) from dn left join n1 using (doc_id)"""
# sentences joined where windows around them stay near each other: 16 bytes of a hash stand for a model's vector
_BY_SENTENCE = "se as (select chunk_id as pid, unnest(x) as text, generate_subscripts(x, 1) as pos from (select chunk_id, "
_BY_MEANING = """
sx as (select chunk_id as pid, x, unnest(range(1, len(x) + 1)) as i from (select chunk_id, {split}),
sv as (select pid, i, x[i] as s, list_transform(range(16), lambda k: ((strpos('0123456789abcdef', h[k * 2 + 1]) - 1) * 16 + strpos('0123456789abcdef', h[k * 2 + 2]) - 1) / 255) as v
  from (select *, sha256(array_to_string(x[greatest(i - 1, 1):i + 1], ' ')) as h from sx)),
sl as (select *, lead(v) over (partition by pid order by i) as b from sv),
sd as (select pid, i, s, case when b is not null then 1 - list_sum(list_transform(list_zip(v, b), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(v, lambda z: z * z)) * list_sum(list_transform(b, lambda z: z * z))) end as d from sl),
sq as (select pid, quantile_cont(d, 0.95) as th from sd group by pid),
sb as (select pid, i, s, coalesce(sum(cast(coalesce(d > th, false) as integer)) over (partition by pid order by i rows between unbounded preceding and 1 preceding), 0) as piece from sd join sq using (pid)),
se as (select pid, string_agg(s, ' ' order by i) as text, piece + 1 as pos from sb group by pid, piece),
"""


def _by_meaning(ctes: str) -> str:
    head, rest = ctes.split(_BY_SENTENCE)
    split, rest = rest.split("),\n", 1)
    return head + _BY_MEANING.format(split=split).lstrip("\n") + rest


@query(f"with recursive {_PROSE_CHUNKS} {_PROSE_ROWS}")
def prose_size_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The prose chunker over all sections and tables, splitting by sentences and size."""
    return _prose(spark, d, prose.by_size)


@query(f"with recursive {_by_meaning(_PROSE_CHUNKS)} {_PROSE_ROWS}")
def prose_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The prose chunker over all sections, with hashed sentence vectors in place of a model."""
    return _prose(spark, d, semantic.splitter(semantic.hashed))


# --- slides ------------------------------------------------------------------------------------------


def _deck(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "docs").filter("file_type = 'pptx'").select("doc_id").distinct()
    secs = table(spark, d, "sections").dropDuplicates(["section_id"]).join(decks, "doc_id")
    return slides.windows(slides.slides(secs, _blocks(spark, d).join(decks, "doc_id")))


_DECK = f"""
decks as (select distinct doc_id from docs where file_type = 'pptx'),
b as (select doc_id, sec_idx, string_agg(text, chr(10) order by block_order, seq, text) as body from (select distinct block_id, doc_id, sec_idx, block_order, seq, text from blocks where {_strip("text")} <> '') group by all),
s as (select distinct doc_id, sec_idx, section_id, heading from sections join decks using (doc_id)),
t as (select s.doc_id, s.sec_idx, coalesce({_strip("heading")}, '') <> '' as headed, heading, body from s left join b using (doc_id, sec_idx)),
k as (select doc_id, sec_idx, case when headed and body is not null then heading || chr(10) || body when headed then heading else body end as text, headed and body is null as divider from t where headed or body is not null),
i as (select *, row_number() over (partition by doc_id order by sec_idx) - 1 as i from k),
w as (select *, string_agg(text, chr(10) || chr(10)) over (partition by doc_id order by i rows between 1 preceding and 1 following) as win,
  coalesce(max(case when divider and i > 0 then i end) over (partition by doc_id order by i), 0) as grp, bool_or(divider) over (partition by doc_id) as sectioned from i),
g as (select doc_id, grp, string_agg(text, chr(10) || chr(10) order by i) as whole from w group by all),
p as (select w.doc_id, w.i, case when sectioned then whole else win end as parent_text from w join g using (doc_id, grp))
"""


@query(f"with {_DECK} select doc_id, cast(i as integer) as i, divider, sectioned, cast(grp as integer) as section_start, sha256(win) as window_hash from w")
def slide_windows(spark: SparkSession, d: str) -> DataFrame:
    return _deck(spark, d).select("doc_id", "i", "divider", "sectioned", F.col("group").alias("section_start"), F.sha2("window", 256).alias("window_hash"))


@query(
    f"""with {_DECK}, f as (select doc_id, parent_text, min(i) as i from p group by all)
    select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as ordinal, substr(sha256(concat_ws(chr(31), doc_id, 'slide-window', 'parent', cast(row_number() over (partition by doc_id order by i) - 1 as varchar), parent_text)), 1, 16) as chunk_id from f"""
)
def slide_parents(spark: SparkSession, d: str) -> DataFrame:
    return slides.parents(slides.parent_texts(_deck(spark, d))).select("doc_id", "ordinal", "chunk_id")


@query(
    f"""with {_DECK}, f as (select doc_id, parent_text, min(i) as i from p group by all),
    up as (select doc_id, parent_text, substr(sha256(concat_ws(chr(31), doc_id, 'slide-window', 'parent', cast(row_number() over (partition by doc_id order by i) - 1 as varchar), parent_text)), 1, 16) as parent_id from f)
    select w.doc_id, cast(w.i as integer) as ordinal, parent_id, substr(sha256(concat_ws(chr(31), w.doc_id, array_to_string(sp, ' > '), 'child', cast(w.i as varchar), text)), 1, 16) as chunk_id
    from w join p using (doc_id, i) join up using (doc_id, parent_text) join (select distinct on (section_id) doc_id, sec_idx, section_path as sp from sections) s using (doc_id, sec_idx)"""
)
def slide_children(spark: SparkSession, d: str) -> DataFrame:
    decks = table(spark, d, "docs").filter("file_type = 'pptx'").select("doc_id").distinct()
    own = lambda df: df.join(decks, "doc_id", "left_semi")
    got = slides.chunks(own(table(spark, d, "sections").dropDuplicates(["section_id"])), own(_blocks(spark, d)))
    first = Window.partitionBy("doc_id").orderBy("chunk_seq")
    return got.filter("role = 'child'").select("doc_id", (F.row_number().over(first) - 1).alias("ordinal"), "parent_id", "chunk_id")


# --- meaning -----------------------------------------------------------------------------------------


@query(
    """with n as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) as a, lead(list_transform(embedding, lambda x: cast(x as double))) over (partition by label order by vec_id) as b from embeddings),
    d as (select label, vec_id, case when b is not null then 1 - list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a, lambda z: z * z)) * list_sum(list_transform(b, lambda z: z * z))) end as dist from n),
    q as (select label, quantile_cont(dist, 0.95) as th from d group by label),
    c as (select label, vec_id, coalesce(dist > th, false) as cut from d join q using (label))
    select label, vec_id, cut, cast(coalesce(sum(cast(cut as integer)) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as bigint) as piece from c"""
)
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    apart = semantic.distances(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    return semantic.breaks(apart, ["label"], "vec_id").select("label", "vec_id", "cut", "piece")


@query("select distinct sha256(text) as hash from chunks where role = 'child' and text is not null and sha256(text) not in (select sha256(text) from blocks where text is not null)")
def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "blocks").filter("text is not null").select(F.sha2("text", 256).alias("hash")).distinct().withColumn("vector", F.array(F.lit(0.0)))
    return semantic.cached(table(spark, d, "chunks").filter("role = 'child'").select("text"), cache, semantic.hashed)[1].select("hash")


def _prose(spark: SparkSession, d: str, splitter: prose.Splitter) -> DataFrame:
    docs = table(spark, d, "docs").filter("file_type in ('pdf', 'docx')").select("doc_id", "title").dropDuplicates(["doc_id"])
    own = lambda name, key: table(spark, d, name).dropDuplicates([key]).join(docs.select("doc_id"), "doc_id", "left_semi")
    tabs = own("table_blocks", "table_id").withColumnRenamed("table_rows", "rows").drop("section_path")
    chunks = prose.chunks(docs, own("sections", "section_id"), own("blocks", "block_id"), tabs, splitter)
    return chunks.select("doc_id", "role", "block_type", "chunk_id", "parent_id", "chunk_seq", F.sha2("text", 256).alias("text_hash"))


# --- results, jobs ------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


_STATS = """
c as (select distinct on (chunk_id) * from chunks),
k as (select doc_id, block_type, count(*) as n, count(*) filter (role = 'parent') as p, count(*) filter (role = 'child') as ch, sum(token_count) as tk from c group by all),
st as (select doc_id, cast(sum(n) as bigint) as chunk_count, cast(sum(p) as bigint) as parent_count, cast(sum(ch) as bigint) as child_count, cast(coalesce(sum(tk), 0) as bigint) as total_tokens, '{' || string_agg('"' || block_type || '":' || n, ',' order by block_type) || '}' as counts_by_block_type from k group by doc_id)
"""


@query(f"with {_STATS} select * from st")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.doc_stats(_chunks(spark, d))


@query(
    f"""with {_STATS}, fl as (select doc_id, bool_or(coalesce(json_extract_string(metadata, '$.routing') = 'structured_query', false)) as guarded, bool_or(coalesce(json_extract_string(metadata, '$.sparse_sheet') = 'true', false)) as sparse from c group by doc_id),
    dd as (select distinct on (doc_id) * from docs left join fl using (doc_id)),
    w as (select *, list_filter([case when parent_strategy in ('PAGE', 'FLAT') then 'parent structure degraded to ' || parent_strategy end, case when guarded then 'scale guard fired: sheet routed to structured_query' end,
      case when sparse then 'sparse sheet detected (pivot/dashboard-like)' end, case when coalesce(empty_slides, 0) > 0 then empty_slides || ' empty slide(s) skipped' end], lambda x: x is not null) as ws from dd)
    select doc_id, case when error is not null then 'failed' when len(ws) > 0 then 'partial' else 'success' end as status, case when error is not null then error else array_to_string(ws, '; ') end as warnings, coalesce(chunk_count, 0) as chunk_count, coalesce(total_tokens, 0) as total_tokens from w left join st using (doc_id)"""
)
def doc_results(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").dropDuplicates(["doc_id"]).join(stats.sheet_flags(_chunks(spark, d)), "doc_id", "left").fillna(False, ["guarded", "sparse_sheet"])
    return stats.results(docs, _chunks(spark, d)).select("doc_id", "status", F.array_join("warnings", "; ").alias("warnings"), "chunk_count", "total_tokens")


@query("with c as (select distinct on (chunk_id) * from chunks where role = 'child' or token_count is not null) select chunk_id, doc_id, parent_id from c where role = 'child' and (parent_id is null or parent_id not in (select chunk_id from c where role = 'parent'))")
def orphan_children(spark: SparkSession, d: str) -> DataFrame:
    """The children left behind if parents without a token count were dropped."""
    return stats.orphans(_chunks(spark, d).filter("role = 'child' or token_count is not null"))


@query(
    """with c as (select distinct on (chunk_id) * from chunks) select text as page_content, chunk_id, doc_id, parent_id, role, block_type, array_to_string(coalesce(section_path, []), ' > ') as section_path, source_uri, file_type, page, slide_number, sheet_name,
    row_range[1] as row_start, row_range[2] as row_end, token_count, array_to_string(list_sort(list_transform(coalesce(json_keys(metadata), []), lambda k: k || '=' || coalesce(json_extract_string(metadata, '$."' || k || '"'), ''))), ';') as extra from c"""
)
def flat_export(spark: SparkSession, d: str) -> DataFrame:
    return stats.flat_export(_chunks(spark, d))


@query("with c as (select distinct on (chunk_id) * from chunks) select doc_id, chunk_seq, chunk_id from c order by doc_id, chunk_seq, chunk_id limit 500 offset 1000")
def chunk_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of chunks: the limit is the feature."""
    return jobs.page(_chunks(spark, d), 1000, 500).select("doc_id", "chunk_seq", "chunk_id")


_LATEST = """
l as (select job_id, file_id, status, progress, updated_at, row_number() over (partition by job_id, file_id order by updated_at desc nulls last, status in ('done', 'partial', 'failed') desc, coalesce(progress, -1) desc, status desc) as r from job_files),
f as (select * from l where r = 1)
"""


@query(f"with {_LATEST} select job_id, file_id, status, progress from f")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(spark, d, "job_files")).select("job_id", "file_id", "status", "progress")


@query(
    f"""with {_LATEST}, a as (select job_id, count(*) as total_files, count(*) filter (status in ('done', 'partial')) as files_done, count(*) filter (status = 'failed') as files_failed,
      cast(round_even(avg(case when status in ('done', 'partial', 'failed') then 100 when status = 'running' then 50 else 0 end), 0) as integer) as progress,
      case when not bool_and(status in ('done', 'partial', 'failed')) then case when bool_or(status <> 'queued') then 'running' else 'queued' end when bool_and(status = 'failed') then 'failed' when bool_or(status in ('failed', 'partial')) then 'partial' else 'done' end as status from f group by job_id)
    select j.job_id, coalesce(total_files, 0) as total_files, coalesce(files_done, 0) as files_done, coalesce(files_failed, 0) as files_failed, coalesce(progress, 0) as progress, coalesce(status, 'queued') as status from (select distinct job_id from jobs) j left join a using (job_id)"""
)
def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rollup(jobs.latest(table(spark, d, "job_files")), table(spark, d, "jobs"))


@query("select job_id, epoch_us(created_at) as created_us from (select job_id, min(created_at) as created_at from jobs group by job_id) order by created_at desc nulls last, job_id limit 50")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 jobs: the limit is the feature."""
    first = table(spark, d, "jobs").groupBy("job_id").agg(F.min("created_at").alias("created_at"))
    return jobs.newest(first).select("job_id", F.unix_micros("created_at").alias("created_us"))
