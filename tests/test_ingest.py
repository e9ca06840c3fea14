import zipfile
from pathlib import Path

import pytest

from foliospark import sinks
from foliospark.operators import jobs, semantic
from foliospark.plans import ingest
from foliospark.sources import files
from foliospark.sources.decoders import Decoded, Registry
from foliospark.streaming import intake

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def para(text, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{text}</w:t></w:r></w:p>"


def land(folder):
    (folder / "sales.csv").write_text("region,revenue\nNorth,1200\nSouth,3400\n")
    (folder / "wide.csv").write_text("a,b\n1,2,3\n")
    (folder / "bad.xlsx").write_bytes(b"not a zip")
    (folder / "skip.txt").write_text("no")
    body = para("Overview", "Heading1") + para("Some text.") + para("Design", "Heading1") + para("More text.") + para("Impl", "Heading2") + para("End.")
    with zipfile.ZipFile(folder / "a b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    with zipfile.ZipFile(folder / "m.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="one" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        cell = '<c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="C1" t="inlineStr"><is><t>c</t></is></c>'
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {S}><sheetData><row r="1">{cell}</row><row r="3"><c r="A3"><v>2</v></c><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')


def test_folder(spark, tmp_path):
    land(tmp_path)
    got = ingest.ingest_folder(spark, str(tmp_path), embed=semantic.hashed)
    by = {r["source_uri"].rsplit("/", 1)[1]: r for r in got.results.collect()}
    assert {k: r["status"] for k, r in by.items()} == {"sales.csv": "success", "wide.csv": "failed", "bad.xlsx": "failed", "a%20b.docx": "success", "m.xlsx": "partial"}
    assert by["a%20b.docx"]["parent_strategy"] == "HEADING"
    again = ingest.ingest_folder(spark, str(tmp_path))
    assert {r["chunk_id"] for r in got.chunks.collect()} == {r["chunk_id"] for r in again.chunks.collect()}
    out = str(tmp_path / "out")
    sinks.write_jsonl(got.chunks, out)
    page, count = sinks.read_jsonl(spark, out, got.chunks.schema, offset=1, limit=2)
    assert count == got.chunks.count() and page.count() == 2
    assert ingest.log_events(got.results).filter("line like '%ingest_failed%'").count() == 2


def test_registered_decoder_and_gate(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"1")
    (tmp_path / "y.pdf").write_bytes(b"2")
    registry = Registry()

    def decode(content, name):
        text = "long enough " * 10 if name == "x.pdf" else "short"
        return Decoded(elements=[{"kind": "text", "text": text, "page": 1}], page_count=1)

    registry.register({"pdf"}, decode)
    got = {r["source_uri"][-5:]: r for r in ingest.ingest_folder(spark, str(tmp_path), registry=registry).results.collect()}
    assert got["x.pdf"]["status"] == "partial" and got["x.pdf"]["parent_strategy"] == "PAGE"
    assert got["y.pdf"]["status"] == "failed" and "quality" in got["y.pdf"]["error"]


def test_same_ids_for_any_partitioning(spark, tmp_path):
    land(tmp_path)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = ingest.ingest_folder(spark, str(tmp_path), embed=semantic.hashed).chunks
        seen.append(sorted((r["chunk_id"], r["parent_id"] or "", r["chunk_seq"]) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_stream(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    land(folder)
    for _ in range(2):  # the second run finds nothing new
        q = intake.start(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    log = spark.read.parquet(str(tmp_path / "o/log"))
    assert log.count() == 5 and log.filter("status = 'failed'").count() == 2


def test_live_states(spark, tmp_path):
    source = Path("/root/testdata/sf0.001/job_files.parquet")
    if not source.exists():
        pytest.skip("no test tables")
    log = spark.read.parquet(str(source))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = intake.live_states(stream).select("job_id", "file_id", "status", "progress").writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = jobs.latest(log).select("job_id", "file_id", "status", "progress")
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, want.collect()))


def test_normalize(spark):
    rows = [("d", 0, "text", "page_header", "Head", 1, None), ("d", 1, "text", "paragraph", "Body", 1, None), ("d", 2, "text", "picture", "p", 1, None), ("d", 3, "section_header", "x", "S", 2, 3), ("d", 4, "text", "paragraph", "T", 2, None)]
    items = spark.createDataFrame(rows, "doc_id string, seq int, item string, label string, text string, page int, level int")
    got = {r["seq"]: (r["kind"], r["level"], r["is_page_start"]) for r in files.normalize(items).collect()}
    assert got == {0: ("heading", 1, False), 1: ("text", None, False), 3: ("heading", 3, False), 4: ("text", None, True)}


def _pages(spark, folder, elements, cfg, kind="pdf"):
    (folder / f"x.{kind}").write_bytes(b"1")
    registry = Registry()
    registry.register({kind}, lambda content, name: Decoded(elements=elements, page_count=1))
    return ingest.ingest_folder(spark, str(folder), cfg, registry=registry).chunks


def test_settings_choose_embedder_and_counter(spark, tmp_path):
    from foliospark.config import Settings

    text = " ".join(f"Sentence number {k} of the careful manual ends here." for k in range(40))
    one = [{"kind": "text", "text": text, "page": 1}]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    small = {"max_child_tokens": 120, "min_child_tokens": 5}
    with pytest.raises(ValueError, match="no embedder registered"):
        _pages(spark, tmp_path / "a", one, Settings(embedding_provider="nobody"))
    with pytest.raises(ValueError, match="vocabulary"):
        _pages(spark, tmp_path / "a", one, Settings(token_counter="tiktoken"))
    calls = []
    semantic.EMBEDDERS["mine"] = lambda cfg: calls.append(cfg) or semantic.hashed
    try:
        _pages(spark, tmp_path / "a", one, Settings(embedding_provider="mine", **small))
    finally:
        del semantic.EMBEDDERS["mine"]
    assert len(calls) == 1
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if Path(ranks).exists():
        sized = _pages(spark, tmp_path / "b", one, Settings(token_counter="tiktoken", token_encoder_model=ranks)).filter("role = 'parent'").first()
        assert sized["token_count"] > len(text.split())


def test_slide_tables(spark, tmp_path):
    from foliospark.config import Settings

    elements = [{"kind": "heading", "text": "Costs", "page": 1, "level": 1}, {"kind": "table", "table_rows": [["a", "b"], ["1", "2"]], "page": 1}, {"kind": "text", "text": "after it", "page": 1}]
    for emit in (False, True):
        (tmp_path / str(emit)).mkdir()
        got = _pages(spark, tmp_path / str(emit), elements, Settings(emit_slide_tables=emit), "pptx").filter("role = 'child'").first()["text"]
        assert got == ("Costs\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter it" if emit else "Costs\nafter it")
