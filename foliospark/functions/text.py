"""Scalar building blocks as native columns: trimming, sizes, identifiers, cells and markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import tokens

STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINES = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
SEPARATOR = "\u001f"
PATH = " > "


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode knows it (``trim`` removes blanks only)."""
    return F.regexp_replace(text, STRIP, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def split_lines(text: Column) -> Column:
    """Lines of a text at any line boundary; a boundary at the end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINES)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def token_count(text: Column) -> Column:
    """Tokens by the configured counter, by default words between ASCII white space; 0 for null."""
    return tokens.count(text)


def sha16(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_id(source_uri: Column, mtime: Column) -> Column:
    """From the file's address and its time of change, written as the shortest decimal."""
    return sha16(source_uri, mtime)


def chunk_id(doc: Column, path: Column, role: Column, ordinal: Column, text: Column) -> Column:
    """The same for the same content in the same place; a null path or text counts as empty."""
    return sha16(doc, F.coalesce(F.array_join(path, PATH), F.lit("")), role, ordinal.cast("string"), F.coalesce(text, F.lit("")))


def escape_cell(cell: Column) -> Column:
    return strip(F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def widest(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))


def pad(row: Column, width: Column) -> Column:
    cells = F.coalesce(row, F.array().cast("array<string>"))
    return F.concat(cells, F.array_repeat(F.lit("").cast("string"), F.greatest(width - F.size(cells), F.lit(0))))


def markdown_row(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, escape_cell), " | "), F.lit(" |"))


def grid_to_markdown(rows: Column, has_header: bool = True) -> Column:
    """A grid as a markdown table: ragged rows are padded, nulls are empty cells, no rows give ''."""
    width = widest(rows)
    full = F.transform(rows, lambda r: pad(r, width))
    if has_header:
        head, body = full[0], F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0)))
    else:
        head, body = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("col_"), i.cast("string"))), full
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(markdown_row(head), rule), F.transform(body, markdown_row))
    return F.when((F.coalesce(F.size(rows), F.lit(0)) > 0) & (width > 0), F.array_join(lines, "\n")).otherwise(F.lit(""))


def serialize_row(columns: Column, cells: Column) -> Column:
    """``a: 1 | b: 2``, with every column, in order; missing and null cells are empty."""
    pairs = F.transform(columns, lambda c, i: F.concat(c, F.lit(": "), F.coalesce(F.get(cells, i), F.lit(""))))
    return F.array_join(pairs, " | ")


def is_numeric(cell: Column) -> Column:
    """Whether a cell reads as a number: digits with an exponent or single underscores, inf, nan."""
    number = r"(?iU)^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"
    return F.coalesce(strip(cell).rlike(number), F.lit(False))


def is_integer(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"(?U)^-*\d+$"), F.lit(False))


def coerce_number(value: Column) -> Column:
    """A numeric cell as text: whole numbers without a fraction, null and NaN as ''."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull() | F.isnan(value), F.lit("")).when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def with_part(path: Column, part: Column, parts: Column) -> Column:
    """``path`` with ``(part i/n)`` behind its last element, or as its only one; as it is for n = 1."""
    mark = F.concat(F.lit("(part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))
    longer = F.concat(F.slice(path, 1, F.size(path) - 1), F.array(F.concat(F.element_at(path, -1), F.lit(" "), mark)))
    return F.when(parts <= 1, path).when(F.size(path) > 0, longer).otherwise(F.array(mark))


def with_table_part(path: Column, part: Column, parts: Column) -> Column:
    mark = F.concat(F.lit("(table part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))
    return F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array(mark))


def table_text(caption: Column, markdown: Column) -> Column:
    return F.concat_ws("\n", F.nullif(caption, F.lit("")), markdown)
