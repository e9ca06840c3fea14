from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.operators import ladder, prose, sections, semantic, slides, stats

ELEMENT = "doc_id string, seq int, kind string, text string, page int, end_page int, level int, is_page_start boolean, table_rows array<array<string>>, table_markdown string, caption string"


def elements(spark, rows):
    full = [{"doc_id": "d", "seq": k, "kind": "text", "text": None, "page": None, "end_page": None, "level": None, "is_page_start": False, "table_rows": None, "table_markdown": None, "caption": None} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], ELEMENT)


def docs(spark, **values):
    row = {"doc_id": "d", "file_type": "pdf", "title": None, "page_count": 3, "num_slides": None, "error": None} | values
    return spark.createDataFrame([tuple(row.values())], "doc_id string, file_type string, title string, page_count int, num_slides int, error string")


def strategy(spark, rows, **values):
    return ladder.strategy(ladder.evidence(elements(spark, rows), docs(spark, **values))).first()


def test_ladder(spark):
    headed = [x for p in (1, 2, 3) for x in ({"kind": "heading", "text": f"H{p}", "page": p}, {"text": "body", "page": p})]
    assert strategy(spark, headed)["parent_strategy"] == "HEADING"
    assert strategy(spark, [{"text": "x", "page": 1}])["parent_strategy"] == "PAGE"
    half = [{"kind": "heading", "text": "a", "page": 1}, {"kind": "heading", "text": "b", "page": 2}, *({"text": "t", "page": p} for p in range(1, 41))]
    got = strategy(spark, half, page_count=40)
    assert (got["parent_strategy"], got["heading_coverage"]) == ("PAGE", 0.05)
    assert strategy(spark, [{"text": "x"}], file_type="docx")["parent_strategy"] == "FLAT"
    assert strategy(spark, headed, file_type="pptx")["parent_strategy"] == "SLIDE"


def test_heading_sections(spark):
    rows = [{"text": "lead", "page": 1}, {"kind": "heading", "text": "A", "level": 1}, {"text": " ", "page": 1}, {"text": "x", "page": 2}, {"kind": "heading", "text": "B", "level": 2}, {"kind": "table", "table_rows": [["a"], ["1"]], "page": 2}]
    parts = sections.by_headings(elements(spark, rows))
    got = {r["sec_idx"]: r for r in parts.sections.collect()}
    assert [list(got[k]["section_path"]) for k in sorted(got)] == [[], ["A"], ["A", "B"]]
    assert (got[1]["page_start"], got[1]["page_end"]) == (2, 2)
    assert parts.blocks.count() == 2 and parts.tables.first()["table_id"] == "d-tbl-0"


def test_pages_bleed_and_carry(spark):
    rows = [{"text": "one two three", "page": 1}, {"text": "spills over", "page": 1, "end_page": 2}, {"text": "four", "page": 2}]
    parts = sections.by_pages(elements(spark, rows), Settings(min_child_tokens=1))
    assert parts.blocks.filter("text = 'spills over'").count() == 2
    merged = sections.by_pages(elements(spark, rows), Settings(min_child_tokens=100)).sections.collect()
    assert len(merged) == 1 and list(merged[0]["section_path"]) == ["Page 2"] and merged[0]["page_start"] == 1


def test_inferred_headings(spark):
    rows = [{"text": "Intro\n\nSome long text that ends here.", "page": 1, "is_page_start": True}, {"text": "Next part\nmore.", "page": 2}]
    found = ladder.candidates(elements(spark, rows))
    assert [r["text"] for r in found.orderBy("seq", "line").collect()] == ["Intro", "Next part"]
    answer = F.lit('[{"line_id":"L0","is_heading":true,"level":9},{"line_id":"L1","is_heading":true,"level":"x"},{"line_id":"L77","is_heading":true,"level":1}]')
    said = ladder.confirmed(found, lambda payload: answer)
    assert sorted((r["line"], r["level"]) for r in said.collect()) == [(0, 1), (0, 4)]
    built = sections.by_headings(ladder.promoted(elements(spark, rows), said)).sections
    assert built.filter("heading = 'Intro'").count() == 1
    assert ladder.confirmed(found, lambda payload: F.lit("no json")).count() == 0


def test_prose_chunks(spark):
    rows = [{"kind": "heading", "text": "A", "level": 1}, {"text": "Just a few words.", "page": 1}, {"kind": "table", "table_rows": [["Region", "Revenue"], ["South", "SENTINEL"]], "page": 1}, {"kind": "heading", "text": "B", "level": 1}, {"kind": "table", "table_rows": [["x"], ["y"]], "page": 2}]
    p = sections.by_headings(elements(spark, rows))
    got = prose.chunks(docs(spark), p.sections, p.blocks, p.tables)
    rows = got.orderBy("chunk_seq").collect()
    assert [(r["role"], r["block_type"]) for r in rows] == [("parent", "text"), ("parent", "text"), ("child", "text"), ("child", "table"), ("child", "table")]
    assert rows[0]["chunk_id"] != rows[1]["chunk_id"] and rows[0]["text"] == "d"
    assert stats.orphans(got).count() == 0
    assert all("SENTINEL" not in r["text"] for r in rows if r["block_type"] == "text")


def test_table_split_repeats_header(spark):
    grid = [["a", "b", "c"], *[[f"r{k}", "x y", "z"] for k in range(40)]]
    tabs = spark.createDataFrame([("t", None, grid, "cap"), ("e", "| x |", None, None)], "table_id string, markdown string, rows array<array<string>>, caption string")
    got = prose.table_pieces(tabs, Settings(max_child_tokens=60)).orderBy("part").collect()
    split = [r for r in got if r["table_id"] == "t"]
    assert len(split) > 1 and all(r["text"].startswith("cap\n| a | b | c |") for r in split)
    assert sum(r["text"].count("| r") for r in split) == 40
    assert [r["text"] for r in got if r["table_id"] == "e"] == ["| x |"]


def test_children_keep_sizes(spark):
    text = "\n\n".join(f"Sentence number {k} has exactly eight words here." for k in range(30))
    up = spark.createDataFrame([("p", text, len(text.split()))], "chunk_id string, text string, token_count int")
    got = [r["text"] for r in prose.pieces(up, cfg=Settings(min_child_tokens=20, max_child_tokens=60)).orderBy("at").collect()]
    assert all(len(x.split()) >= 20 for x in got) and " ".join(got).split() == text.split()
    split = spark.createDataFrame([("w " * 95 + "\n\n" + "v " * 10,)], "s string").select(prose.recursive_split(F.col("s"), 30).alias("x")).first()["x"]
    assert all(len(x.split()) <= 30 for x in split) and sum(len(x.split()) for x in split) == 105


def test_slides(spark):
    rows = [x for p in (1, 2, 3) for x in ({"kind": "heading", "text": f"T{p}", "page": p}, {"text": f"body {p}", "page": p})]
    deck = sections.by_slides(elements(spark, rows), docs(spark, file_type="pptx", num_slides=4))
    got = slides.chunks(deck.sections, deck.blocks)
    children = got.filter("role = 'child'").orderBy("chunk_seq").collect()
    assert [r["text"] for r in children] == ["T1\nbody 1", "T2\nbody 2", "T3\nbody 3"]
    middle = got.filter(F.col("chunk_id") == children[1]["parent_id"]).first()["text"]
    assert "body 1" in middle and "body 3" in middle
    assert slides.slides(deck.sections, deck.blocks).filter("empty").count() == 1


def test_semantic_breaks_and_cache(spark):
    vectors = spark.createDataFrame([("k", i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "k string, i int, v array<double>")
    apart = semantic.breaks(semantic.distances(vectors, ["k"], "i", "v"), ["k"], "i").orderBy("i").collect()
    assert [r["piece"] for r in apart] == [0] * 5 + [1] * 5
    for kind, amount in (("standard_deviation", 1.0), ("interquartile", 1.5), ("gradient", 95.0)):
        assert semantic.breaks(semantic.distances(vectors, ["k"], "i", "v"), ["k"], "i", kind, amount).count() == 10
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    cache = texts.filter("text = 'a'").select(F.sha2("text", 256).alias("hash"), semantic.hashed(F.col("text")).alias("vector")).distinct()
    every, new = semantic.cached(texts, cache, semantic.hashed)
    assert every.count() == 2 and new.count() == 1
    got = spark.createDataFrame([("a",)], "s string").select(semantic.hashed(F.col("s")).alias("v")).first()["v"]
    assert list(got) == semantic.hashed_vector("a")


def test_merged_pages_take_turns(spark):
    rows = [(0, "text", "a1", 1), (1, "text", "a2", 1), (2, "text", "b1", 2), (3, "text", "b2", 2)]
    frame = spark.createDataFrame([("d", s, k, x, p, None, None, None, None, None, None) for s, k, x, p in rows], "doc_id string, seq int, kind string, text string, page int, end_page int, level int, is_page_start boolean, table_rows array<array<string>>, table_markdown string, caption string")
    for turns, want in ((False, ["a1", "a2", "b1", "b2"]), (True, ["a1", "b1", "a2", "b2"])):
        parts = sections.by_pages(frame, Settings(min_child_tokens=100, interleave_merged_pages=turns))
        assert [r["text"] for r in parts.blocks.orderBy("block_order").collect()] == want
