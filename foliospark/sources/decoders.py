"""File decoders: bytes to elements or grids, errors as rows.

A decoder is a function ``bytes -> Decoded``; ``REGISTRY`` maps extensions to them, later
registrations come first. All formats are read with the standard library.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

from foliospark.sources import pdf

# What table readers take for a missing cell.
MISSING = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


@dataclass
class Decoded:
    """``elements`` as dicts of kind, text, page, level, table_rows, caption; ``sheets`` as (name, rows)."""

    elements: list[dict] = field(default_factory=list)
    sheets: list[tuple[str, list[list[str | None]]]] = field(default_factory=list)
    page_count: int | None = None
    num_slides: int | None = None
    title: str | None = None


Decoder = Callable[[bytes, str], Decoded]


def decode_csv(content: bytes, name: str) -> Decoded:
    """One sheet named like the file; blank lines are skipped, missing values are empty, and a row
    wider than the first is an error."""
    rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if r]
    if not rows:
        raise ValueError("no columns to parse from file")
    width = len(rows[0])
    for k, r in enumerate(rows):
        if len(r) > width:
            raise ValueError(f"expected {width} fields in line {k + 1}, saw {len(r)}")
    return Decoded(sheets=[(name.rsplit(".", 1)[0], [[None if c in MISSING else c for c in r] + [None] * (width - len(r)) for r in rows])])


def _tree(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _targets(archive: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    if rels not in archive.namelist():
        return {}
    return {r.get("Id", ""): (t[1:] if (t := r.get("Target", "")).startswith("/") else f"{base}/{t}") for r in _tree(archive, rels)}


# Numbers of the built-in formats that show dates or times.
_DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = _tree(archive, "xl/styles.xml")
    own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\\.|\[[^\]hms]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_S}numFmt")}
    dated = {k for k, code in own.items() if re.search(r"[ymdhs]", code, re.I)}
    styles = root.find(f"{_S}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if (n := int(x.get("numFmtId", 0))) in dated or (n in _DATES and n not in own)}


def _date(serial: float, epoch: datetime) -> str:
    at = epoch + timedelta(seconds=round(serial * 86400))
    return str(at.time()) if 0 <= serial < 1 else str(at)


def decode_xlsx(content: bytes, name: str) -> Decoded:
    """Every sheet in workbook order; whole numbers without a fraction, dates and times as ISO text,
    missing cells as null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _tree(z, "xl/sharedStrings.xml").iter(f"{_S}si")]
        paths = _targets(z, "xl/_rels/workbook.xml.rels", "xl")
        dated = _date_styles(z)
        settings = _tree(z, "xl/workbook.xml").find(f"{_S}workbookPr")
        epoch = datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        out = Decoded()
        for sheet in _tree(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            grid: list[list[str | None]] = []
            for row in _tree(z, paths[sheet.get(f"{_R}id", "")]).iter(f"{_S}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{_S}c"):
                    at = 0
                    for ch in re.sub(r"\d", "", c.get("r", "")):
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - 1 - len(cells))
                    kind, v = c.get("t"), c.find(f"{_S}v")
                    if kind == "inlineStr":
                        value: str | None = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        value = None
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind in ("str", "e"):
                        value = v.text
                    elif kind == "b":
                        value = "True" if v.text == "1" else "False"
                    else:
                        number = float(v.text)
                        value = _date(number, epoch) if int(c.get("s", 0)) in dated else str(int(number)) if number.is_integer() else repr(number)
                    cells.append(value.strip() if value is not None else None)
                number = int(row.get("r", len(grid) + 1))
                grid += [[] for _ in range(number - 1 - len(grid))]
                grid.append(cells)
            out.sheets.append((sheet.get("name", ""), grid))
        return out


def _paragraph(p: ElementTree.Element, ns: str) -> str:
    return "".join((n.text or "") if n.tag == f"{ns}t" else "\n" if n.tag == f"{ns}br" else "\t" if n.tag == f"{ns}tab" else "" for n in p.iter())


def _content(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The parts of a body, with those of content controls."""
    for part in node:
        if part.tag == f"{_W}sdt":
            inner = part.find(f"{_W}sdtContent")
            yield from _content(inner) if inner is not None else ()
        else:
            yield part


def decode_docx(content: bytes, name: str) -> Decoded:
    """Paragraphs and tables of the body in order; styles named Heading n or Title are headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out = Decoded()
        body = _tree(z, "word/document.xml").find(f"{_W}body")
        for node in _content(body) if body is not None else ():
            if node.tag == f"{_W}p":
                text = _paragraph(node, _W)
                style = node.find(f"{_W}pPr/{_W}pStyle")
                heading = re.match(r"(?i)heading\s*(\d+)|title$", style.get(f"{_W}val", "")) if style is not None else None
                if text.strip():
                    out.elements.append({"kind": "heading" if heading else "text", "text": text, "level": int(heading[1] or 1) if heading else None})
                    if heading and out.title is None:
                        out.title = text.strip()
            elif node.tag == f"{_W}tbl":
                rows = [["\n".join(_paragraph(p, _W) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
                out.elements.append({"kind": "table", "table_rows": rows})
        return out


def decode_pptx(content: bytes, name: str) -> Decoded:
    """Slides in presentation order: title shapes are headings, other shapes text, tables tables,
    speaker notes text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        paths = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt")
        order = [paths[s.get(f"{_R}id", "")] for s in _tree(z, "ppt/presentation.xml").iter(f"{_P}sldId")]
        out = Decoded(num_slides=len(order), page_count=len(order))

        def shapes(root: ElementTree.Element, page: int, notes: bool) -> None:
            for shape in root.iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    role = kind.get("type", "") if kind is not None else ""
                    if notes and role != "body" or role in ("sldNum", "dt", "ftr", "hdr"):
                        continue
                    text = "\n".join(_paragraph(p, _A) for p in shape.iter(f"{_A}p")).strip()
                    if text:
                        head = role in ("title", "ctrTitle") and not notes
                        out.elements.append({"kind": "heading" if head else "text", "text": text, "page": page, "level": 1 if head else None})
                elif shape.tag == f"{_A}tbl":
                    rows = [["\n".join(_paragraph(p, _A) for p in c.iter(f"{_A}p")) for c in r.findall(f"{_A}tc")] for r in shape.findall(f"{_A}tr")]
                    out.elements.append({"kind": "table", "table_rows": rows, "page": page})

        for k, path in enumerate(order, 1):
            shapes(_tree(z, path), k, False)
            rels = path.replace("slides/", "slides/_rels/") + ".rels"
            for target in _targets(z, rels, "ppt/slides").values():
                target = target.replace("slides/../", "")
                if "notesSlide" in target and target in z.namelist():
                    shapes(_tree(z, target), k, True)
        return out


def decode_pdf(content: bytes, name: str) -> Decoded:
    """Pages in order: larger or bold lines are headings, aligned rows tables, lines close together text."""
    found, pages, title = pdf.elements(content)
    named = title or next((e["text"] for e in found if e["kind"] == "heading"), None)
    return Decoded(elements=found, page_count=pages, title=named)


_REGISTERED: list[tuple[set[str], Decoder]] = [
    ({"csv"}, decode_csv), ({"xlsx"}, decode_xlsx), ({"docx"}, decode_docx), ({"pptx"}, decode_pptx), ({"pdf"}, decode_pdf),
]


class Registry:
    """Decoders by extension; what is registered later is asked first."""

    def __init__(self) -> None:
        self._known = list(_REGISTERED)

    def register(self, extensions: set[str], decoder: Decoder) -> None:
        self._known.insert(0, (extensions, decoder))

    def find(self, extension: str) -> Decoder:
        for extensions, decoder in self._known:
            if extension.lower().lstrip(".") in extensions:
                return decoder
        raise ValueError(f"unsupported file type: {extension!r}")

    def extensions(self) -> set[str]:
        return set().union(*(e for e, _ in self._known))


REGISTRY = Registry()
