import base64
import zlib

import pytest

from foliospark.config import Settings
from foliospark.operators import semantic
from foliospark.plans import ingest
from foliospark.sources import decoders, pdf


def build(pages, encode="flate", packed=False, extra=""):
    """A PDF of pages of ``(x, y, size, bold, text)``."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    number = 5
    for page in pages:
        body = b"".join(b"BT /F%d %d Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (2 if bold else 1, size, x, y, text.replace("(", r"\(").replace(")", r"\)").encode("cp1252")) for x, y, size, bold, text in page)
        filters = b"/FlateDecode"
        body = zlib.compress(body)
        if encode == "ascii85":
            body, filters = base64.a85encode(body) + b"~>", b"[ /ASCII85Decode /FlateDecode ]"
        objects[number] = b"<< /Length %d /Filter %s >>\nstream\n%s\nendstream" % (len(body), filters, body)
        objects[number + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % number
        kids.append(b"%d 0 R" % (number + 1))
        number += 2
    objects[2] = b"<< /Type /Pages /Kids [ %s ] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (b" ".join(kids), len(kids))
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"
    out = b"%PDF-1.5\n"
    if packed:  # objects without streams in an object stream
        inside = {k: v for k, v in objects.items() if b"stream" not in v}
        heads, body = b"", b""
        for k, v in inside.items():
            heads += b"%d %d " % (k, len(body))
            body += v + b" "
        data = zlib.compress(heads + body)
        objects = {k: v for k, v in objects.items() if k not in inside}
        objects[number] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(inside), len(heads), len(data), data)
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    return out + b"trailer << /Root 1 0 R %s >>\n%%%%EOF\n" % extra.encode()


def paragraph(y, text, lines=3):
    return [(72, y - 12 * k, 10, False, text) for k in range(lines)]


def headed():
    page = [(72, 740, 18, True, "1. Introduction"), *paragraph(710, "This document introduces the architecture (in full).")]
    page += [(72, 650, 18, True, "2. Results"), *paragraph(620, "The measured results are summarized below.")]
    page += [(x, y, 10, False, t) for y, row in ((560, ("Region", "Revenue")), (542, ("North", "1200")), (524, ("South", "SENTINEL_CELL_9999"))) for x, t in zip((240, 330), row)]
    return [page + [(72, 480, 18, True, "3. Conclusion"), *paragraph(450, "We conclude with next steps.")]]


@pytest.mark.parametrize("how", [{}, {"encode": "ascii85"}, {"packed": True}])
def test_headings_paragraphs_and_tables(how):
    found, pages, _ = pdf.elements(build(headed(), **how))
    assert pages == 1
    assert [(e["kind"], e.get("level")) for e in found] == [("heading", 1), ("text", None), ("heading", 1), ("text", None), ("table", None), ("heading", 1), ("text", None)]
    assert found[0]["text"] == "1. Introduction" and found[1]["text"].count("\n") == 2 and "(in full)" in found[1]["text"]
    assert found[4]["table_rows"] == [["Region", "Revenue"], ["North", "1200"], ["South", "SENTINEL_CELL_9999"]]


def test_damaged_and_encrypted():
    whole = build(headed())
    found, _, _ = pdf.elements(whole[: whole.rindex(b"trailer")])  # no index at all
    assert len(found) == 7
    with pytest.raises(ValueError, match="encrypted"):
        pdf.elements(build(headed(), extra="/Encrypt 9 0 R"))
    with pytest.raises(ValueError, match="no pages"):
        pdf.elements(b"not a pdf")
    assert decoders.decode_pdf(build(headed(), extra="/Info << /Title (A title) >>"), "x.pdf").title == "A title"


def test_character_maps():
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <00620063> endbfrange 1 beginbfrange <04> <05> [ <00780079> <007A> ] endbfrange"
    assert pdf.Font._cmap(cmap) == {1: "A", 2: "bc", 3: "bd", 4: "xy", 5: "z"}
    font = pdf.Font(pdf.File(b""), {"Subtype": "Type1", "Encoding": {"Differences": [65, pdf.Name("uni00E9"), pdf.Name("germandbls"), pdf.Name("quotedblleft")]}})
    assert "".join(c for _, c, _ in font.codes(b"ABCD")) == "éß“D"
    assert pdf._string(b"a\\(b\\051 (c)\\\nd\\101)", 0)[0] == b"a(b) (c)dA"


def test_pipeline(spark, tmp_path):
    flat = [paragraph(740 - 100 * k, "Uniform paragraph with no heading structure.", 5) for k in range(4)]
    half = [[(72, 740, 18, True, f"Part {k}"), *paragraph(700, "Text of the part that follows, in full.", 6)] if k < 2 else paragraph(700, "More text without any heading here.", 6) for k in range(40)]
    for name, pages in (("headed", headed()), ("flat", flat), ("half", half), ("scanned", [[], []])):
        (tmp_path / f"{name}.pdf").write_bytes(build(pages))
    done = ingest.ingest_folder(spark, str(tmp_path), Settings(min_chars_per_page=20), embed=semantic.hashed)
    by = {r["source_uri"].rsplit("/", 1)[-1]: r for r in done.results.collect()}
    assert {k: r["parent_strategy"] for k, r in by.items()} == {"headed.pdf": "HEADING", "flat.pdf": "PAGE", "half.pdf": "PAGE", "scanned.pdf": None}
    assert by["scanned.pdf"]["status"] == "failed" and "quality" in by["scanned.pdf"]["error"]
    assert round({r["source_uri"].rsplit("/", 1)[-1]: r["heading_coverage"] for r in done.docs.collect()}["half.pdf"], 3) == 0.05
    chunks = done.chunks.filter("source_uri like '%headed.pdf'").collect()
    assert {c["block_type"] for c in chunks if "SENTINEL_CELL_9999" in c["text"]} == {"table"}
    parents = {c["chunk_id"] for c in chunks if c["role"] == "parent"}
    assert all(c["parent_id"] in parents for c in chunks if c["role"] == "child")
    one = ingest.ingest_file(spark, str(tmp_path / "flat.pdf"), embed=semantic.hashed)
    assert [r["parent_strategy"] for r in one.results.collect()] == ["PAGE"]
