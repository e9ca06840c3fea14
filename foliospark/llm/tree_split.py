"""Splitting oversized items at natural boundaries, by packing the item's structure tree.

A text is a tree. Headings own what follows them, down to the next heading of their depth or above
(``#`` to ``######``, ``1.1`` to ``1.1.1.1``, ``<h1>`` to ``<h6>``, lines that stand alone like titles);
markup elements own what is nested in them; list items own the items indented below them; then
come paragraphs, lines, sentences, clauses and words. Sibling subtrees that fit are merged, in order,
up to the limit. Only a node that is itself too large is descended into, and its pieces stay its own:
none holds the end of one subtree with the beginning of another. Below lines, where there is no more
structure than running text, rests are filled up. A table is a tree of rows, cells and words, its header row
repeated in every piece.

Sizes are tokens: maximal runs without (Unicode) white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.order import running_sum
from foliospark.workspace import materialize

# The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(f"[^{WHITE}]+")
_ITEM = re.compile(r"(?:[-*+•◦▪‣☐☑✓–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])$")
_HEADING = re.compile(r"(?:(#{1,6})\s|(\d+(?:\.\d+)+)\.?\s+\S|<h([1-6])[\s>])")
_TAG = re.compile(r"<(/?)(section|article|div|table|tbody|thead|tr|td|th|ul|ol|dl|li|p|pre|blockquote)\b[^>]*?(/?)>", re.I)
# Ranks of boundaries: a higher one is a boundary higher in the tree.
_HEAD, _MARKUP, _PARAGRAPH, _LISTED, _LINE, _SENTENCE, _CLAUSE = 100, 90, 50, 48, 20, 10, 5
_SPAN = 64
_MOST_KINDS = 1000


def cut_kind(rank: int) -> str:
    """What a boundary of a rank is called."""
    names = ((91, "heading"), (51, "element"), (_PARAGRAPH, "paragraph"), (_LINE + 1, "item"), (_LINE, "line"), (_SENTENCE, "sentence"), (_CLAUSE, "clause"))
    return next((name for least, name in names if rank >= least), "word")


def token_count(text: Column) -> Column:
    """Tokens of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def _line(text: str, start: int) -> str:
    end = text.find("\n", start)
    return text[start : end if end >= 0 else len(text)][:200]


def _depth(line: str) -> int:
    """How deep a heading is, 0 if the line is none."""
    m = _HEADING.match(line.lstrip())
    if not m:
        return 0
    return len(m[1]) if m[1] else min(6, m[2].count(".") + 1) if m[2] else int(m[3])


class _Nesting:
    """How deep the markup elements and the items of a list are at a place."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.indents: list[int] = []

    def item(self, indent: int) -> int:
        while self.indents and self.indents[-1] > indent:
            self.indents.pop()
        if not self.indents or self.indents[-1] < indent:
            self.indents.append(indent)
        return min(len(self.indents) - 1, 20)

    def element(self, closing: bool, name: str, empty: bool) -> int:
        """The depth an element opens at; closing tags close what was left open within."""
        if closing:
            if name in self.open:
                while self.open.pop() != name:
                    pass
            return len(self.open)
        depth = len(self.open)
        if not empty:
            self.open.append(name)
        return depth


def _strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, the rank of the boundary before it (the first has 0).

    A heading is kept with what follows it: the boundary after its line is a weak one.
    """
    out = np.zeros(len(spans), np.int16)
    first = _line(text, spans[0][0])
    heading = _depth(first) > 0
    nest, marked = _Nesting(), "<" in text
    listed = bool(_ITEM.match(text[spans[0][0] : spans[0][1]]))
    if listed:
        nest.item(0)
    for k in range(len(spans)):
        start = spans[k][0]
        opened = -1
        if marked and "<" in text[start : spans[k][1]]:
            for m in _TAG.finditer(text, start, max(spans[k][1], text.find(">", start) + 1)):
                depth = nest.element(bool(m[1]), m[2].lower(), bool(m[3]))
                if opened < 0 and m.start() == start and not m[1]:
                    opened = depth
        if not k:
            continue
        end = spans[k - 1][1]
        gap = text[end:start]
        breaks = gap.count("\n")
        if opened >= 0:
            out[k] = _MARKUP - min(opened, 30)
            heading = False
        elif breaks or any(c in gap for c in "\r\f\u2028\u2029"):
            line = _line(text, start)
            depth = _depth(line)
            if not depth and breaks > 1 and len(line) < 80 and line[-1:] not in ".,;:" and line[:1].isupper():
                depth = 7
            item = bool(_ITEM.match(text[start : spans[k][1]]))
            indent = len(gap) - max(gap.rfind(c) for c in "\n\r\f\u2028\u2029") - 1
            if heading and not depth:
                out[k] = _CLAUSE
            elif depth:
                out[k] = _HEAD - depth
            elif item:
                level = nest.item(indent)
                out[k] = _LISTED - level if listed or breaks < 2 else _PARAGRAPH
            elif breaks > 1 or "\f" in gap or "\u2029" in gap:
                if not (listed and indent):  # indented below an item, a paragraph belongs to it
                    out[k], listed = _PARAGRAPH, False
                    nest.indents.clear()
                else:
                    out[k] = _LINE + 1
            else:
                out[k] = _LINE
            if item:
                listed = True
            elif depth:
                listed = False
                nest.indents.clear()
            heading = depth > 0
        else:
            last = text[end - 1]
            if last in ")\"'”’»]" and end >= 2:
                last = text[end - 2]
            if last in ".!?…。":
                out[k] = _SENTENCE
            elif last in ",;:)|" or text[end - 1] == ")":
                out[k] = _CLAUSE
    return out


def _pack(first: int, last: int, rank: np.ndarray, limit: int, more: int = 0) -> list[tuple[int, int]]:
    """Token range [first, last) as ranges of at most ``limit`` tokens, the first of ``limit + more``."""
    if last - first <= limit + more:
        return [(first, last)]
    top = int(rank[first + 1 : last].max())
    if top == 0:
        return [(first, first + limit + more), *((at, min(at + limit, last)) for at in range(first + limit + more, last, limit))]
    cuts = (np.flatnonzero(rank[first + 1 : last] == top) + first + 1).tolist()
    out: list[tuple[int, int]] = []
    closed = False  # whether the last piece may not grow: it is part of an oversized node
    for a, b in zip([first, *cuts], [*cuts, last]):
        room = limit + (more if a == first else 0)
        for piece in _pack(a, b, rank, limit, more if a == first else 0):
            if out and not closed and piece[1] - out[-1][0] <= limit + (more if len(out) == 1 else 0):
                out[-1] = (out[-1][0], piece[1])
            else:
                out.append(piece)
            closed = top >= _LINE and b - a > room
    return out


def split_text(text: str | None, limit: int, overlap: int, lead: str = "") -> list[tuple[str, int, int, str]]:
    """Pieces ``(text, tokens, tokens shared with the piece before, kind of the cut before it)``.

    Without blank edges, every token of ``text`` is in one piece besides the overlaps. ``lead`` is
    what comes right before ``text``: the first piece shares its last tokens. Each piece has a token
    of its own, so an overlap of the limit or more counts as one less; a limit under 1 as 1.
    """
    text = text or ""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    before = [m.span() for m in _TOKEN.finditer(lead)][-overlap:] if overlap and lead else []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    if before:
        start = before[0][0]
        text, shift = lead[start:] + text, len(lead) - start
        spans = [(a - start, b - start) for a, b in before] + [(a + shift, b + shift) for a, b in spans]
    skip = len(before)
    strength = _strengths(text, spans)
    out = []
    for a, b in _pack(skip, len(spans), strength, limit - overlap, overlap - skip):
        shared = min(overlap, a)
        out.append((text[spans[a - shared][0] : spans[b - 1][1]], b - a + shared, shared, cut_kind(int(strength[a])) if a else "start"))
    return out


def _cells(row: list[str | None] | None) -> list[int]:
    return [len(_TOKEN.findall(c)) if c else 0 for c in row or []]


def split_table(rows: list[list[str | None] | None] | None, limit: int) -> list[tuple[list, int, int, str]]:
    """Pieces ``(rows, tokens, header tokens, kind of the cut before it)`` of at most ``limit`` tokens.

    The header row leads every piece, unless it leaves no room for a token, when it is a row like any
    other. A row that is too large becomes several, each with some of its cells, or parts of a
    cell, in their columns and the others empty. Null rows are empty rows.
    """
    rows = [list(r or []) for r in rows or []]
    if not rows:
        return []
    head = sum(_cells(rows[0]))
    keep = head < limit
    room = max(1, limit - head) if keep else max(1, limit)
    body, units = rows[1:] if keep else rows, []
    for row in body:
        sizes = _cells(row)
        if sum(sizes) <= room:
            units.append((row, sum(sizes), "row"))
            continue
        part: list = [None] * len(row)
        filled, kind = 0, "row"
        for at, (cell, size) in enumerate(zip(row, sizes)):
            pieces = split_text(cell, room, 0) if size > room else [(cell, size, 0, "cell")]
            for text, tokens, _, cut in pieces:
                if filled and filled + tokens > room:
                    units.append((part, filled, kind))
                    part, filled, kind = [None] * len(row), 0, "cell" if cut == "start" else cut
                part[at] = text if part[at] is None else f"{part[at]} {text}"
                filled += tokens
        units.append((part, filled, kind))
    out: list[tuple[list, int, int, str]] = []
    lead = [rows[0]] if keep else []
    for row, tokens, kind in units:
        if out and out[-1][1] + tokens <= head * keep + room:
            out[-1] = ([*out[-1][0], row], out[-1][1] + tokens, head * keep, out[-1][3])
        else:
            out.append(([*lead, row], head * keep + tokens, head * keep, kind if out else "start"))
    return out or [(lead, head, head, "start")]


_PIECE = "item_kind string, item_id string, item_tokens bigint, max_tokens int, span int, at int, tokens int, shared_tokens int, cut string, text string, table_rows array<array<string>>"


def _run(items: DataFrame) -> DataFrame:
    """Oversized ``(item_kind, item_id, item_tokens, max_tokens, overlap_tokens, span, lead, text, table_rows)``."""
    schema = pa.schema([("item_kind", pa.string()), ("item_id", pa.string()), ("item_tokens", pa.int64()), ("max_tokens", pa.int32()), ("span", pa.int32()), ("at", pa.int32()), ("tokens", pa.int32()), ("shared_tokens", pa.int32()), ("cut", pa.string()), ("text", pa.string()), ("table_rows", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                same = {c: item[c] for c in ("item_kind", "item_id", "item_tokens", "max_tokens", "span")}
                if item["table_rows"] is not None:
                    found = [(None, t, s, cut, rows) for rows, t, s, cut in split_table(item["table_rows"], item["max_tokens"])]
                else:
                    found = [(x, t, s, cut, None) for x, t, s, cut in split_text(item["text"], item["max_tokens"], item["overlap_tokens"] or 0, item["lead"] or "")]
                rows = [same | dict(at=k, text=x, tokens=t, shared_tokens=s, cut=cut, table_rows=r) for k, (x, t, s, cut, r) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return items.select("item_kind", "item_id", "item_tokens", "max_tokens", "overlap_tokens", "span", "lead", "text", "table_rows").mapInArrow(run, _PIECE)


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of ``items(item_kind, item_id, item_tokens, ...)`` above their kind's limit, with it.

    ``limits(item_kind, max_tokens, overlap_tokens)`` has a row for each kind; kinds without one, or
    with a null limit, have no limit. There are few kinds (an error above 1000), so they become literals.
    """
    rows = limits.dropDuplicates(["item_kind"]).filter("item_kind is not null and max_tokens is not null").limit(_MOST_KINDS + 1).collect()
    if len(rows) > _MOST_KINDS:
        raise ValueError(f"more than {_MOST_KINDS} kinds of items")
    of = lambda c: F.create_map(*[F.lit(x) for r in rows for x in (r["item_kind"], r[c])])[F.col("item_kind")].cast("int")
    if not rows:
        return items.withColumns({"max_tokens": F.lit(0), "overlap_tokens": F.lit(0)}).filter(F.lit(False))
    return items.withColumns({"max_tokens": of("max_tokens"), "overlap_tokens": of("overlap_tokens")}).filter("item_tokens > max_tokens")


def texts_to_split(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """From ``texts(item_kind, item_id, text)``: what exceeds its limit. Repeated ids count once."""
    sized = texts.withColumn("item_tokens", token_count(F.col("text")).cast("bigint"))
    return (
        oversized(sized, limits)
        .dropDuplicates(["item_kind", "item_id"])
        .withColumns({"span": F.lit(0), "lead": F.lit(None).cast("string"), "table_rows": F.lit(None).cast("array<array<string>>")})
    )


def tables_to_split(tables: DataFrame, limits: DataFrame) -> DataFrame:
    """From ``tables(item_kind, item_id, table_rows)``; the size is that of all cells together."""
    size = F.aggregate(F.flatten(F.filter("table_rows", lambda r: r.isNotNull())), F.lit(0).cast("bigint"), lambda n, c: n + token_count(c))
    sized = tables.withColumn("item_tokens", F.coalesce(size, F.lit(0).cast("bigint")))
    return (
        oversized(sized, limits)
        .dropDuplicates(["item_kind", "item_id"])
        .withColumns({"span": F.lit(0), "lead": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    )


def blocks_to_split(blocks: DataFrame, limits: DataFrame, kind: str = "section") -> DataFrame:
    """From ``blocks(item_id, block_id, place, text)``: items made of many blocks, joined by blank
    lines in order of ``place``, then ``block_id``.

    Repeated blocks count once. Sizes come first, without texts, so that only oversized items bring
    theirs. However large an item is, no task holds more of it than about 64 limits: it is handed on
    in spans of whole blocks, each led in by as many blocks before it as the overlap needs.
    """
    sized = blocks.select("item_id", "block_id", "place", token_count(F.col("text")).cast("bigint").alias("tokens")).dropDuplicates(["item_id", "block_id"])
    total = sized.groupBy("item_id").agg(F.sum("tokens").alias("item_tokens")).withColumn("item_kind", F.lit(kind))
    large = oversized(total, limits)
    width = F.col("max_tokens") * _SPAN
    order = [F.col("place").asc_nulls_last(), "block_id"]
    placed = running_sum(sized.join(large, "item_id"), ["item_id"], "place", order, F.col("tokens"), "upto", kind="bigint")
    placed = materialize(placed.withColumn("span", F.floor((F.col("upto") - F.col("tokens")) / width).cast("int")), "split-places")
    starts = placed.groupBy("item_id", "span").agg(F.min(F.col("upto") - F.col("tokens")).alias("start"))
    ahead = F.array_distinct(F.array(F.floor(F.col("upto") / width).cast("int"), F.floor((F.col("upto") + F.coalesce("overlap_tokens", F.lit(0))) / width).cast("int")))
    told = ["item_kind", "item_id", "item_tokens", "max_tokens", "overlap_tokens", "span"]
    leads = (
        placed.withColumn("_own", F.col("span")).withColumn("span", F.explode(ahead)).filter("span > _own")
        .join(starts, ["item_id", "span"]).filter("start >= upto and start < upto + overlap_tokens")
    )
    marks = placed.select(*told, "block_id", "place", F.lit(False).alias("lead")).unionByName(leads.select(*told, "block_id", "place", F.lit(True).alias("lead")))
    texts = blocks.select("item_id", "block_id", "text").join(marks, ["item_id", "block_id"]).dropDuplicates(["item_id", "block_id", "span", "lead"])
    piece = F.struct(F.col("place").isNull().alias("late"), "place", "block_id", "lead", "text")
    grouped = texts.groupBy(*told).agg(F.array_sort(F.collect_list(piece)).alias("b"))
    of = lambda lead: F.array_join(F.transform(F.filter("b", lambda x: x["lead"] == lead), lambda x: x["text"]), "\n\n")
    return grouped.select(
        *told, F.when(of(True) != "", F.concat(of(True), F.lit("\n\n"))).alias("lead"), of(False).alias("text"),
        F.lit(None).cast("array<array<string>>").alias("table_rows"),
    )


def split(items: DataFrame) -> DataFrame:
    """The pieces of what ``*_to_split`` gave: ``(item_kind, item_id, item_tokens, max_tokens,
    piece_no, tokens, shared_tokens, cut, text, table_rows)``, ``piece_no`` from 0 in reading order.
    """
    pieces = materialize(_run(items), "pieces")
    per = pieces.filter("span > 0").select("item_kind", "item_id").distinct()
    counts = pieces.join(per, ["item_kind", "item_id"], "left_semi").groupBy("item_kind", "item_id", "span").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("item_kind", "item_id").orderBy("span")  # a row a span
    before = counts.withColumn("before", F.sum("n").over(in_order) - F.col("n")).drop("n")
    numbered = pieces.join(before, ["item_kind", "item_id", "span"], "left").withColumn("piece_no", (F.coalesce("before", F.lit(0)) + F.col("at")).cast("int"))
    return numbered.drop("span", "at", "before")
