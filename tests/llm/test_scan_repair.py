from foliospark.llm import scan_repair as sr

WORDS = "the paragraph of this manual describes how section and folder are kept in a common library for every careful reader non-deterministic publication".split()
BLOCK = "doc_id string, sec_idx int, block_id string, block_order int, page int, text string"


def lexicon():
    return sr.Lexicon({w: 1000 for w in WORDS}, sure=frozenset(["the"]))


def fixed(text):
    b = sr.Block("b", 1, text.split("\n"))
    sr.repair_blocks([b], lexicon())
    return b


def test_glyphs():
    b = fixed("the rnanual describes sectiori and fo1der for every carefuI reader")
    assert " ".join(b.words) == "the manual describes section and folder for every careful reader" and b.noise == {"glyph"}
    assert fixed("the man ual is kept").noise == {"glyph"} and " ".join(fixed("the man ual is kept").words) == "the manual is kept"
    for clean in ("the maunal of this reader", "Tebarka (c) KF-612 and folder_12.docx", "zxq vb 123 45", "folders reader's"):
        assert not fixed(clean).noise, clean


def test_hyphens():
    b = fixed("the para-\ngraph of the pub¬ \nlication, and non-\ndeterministic folder")
    assert " ".join(b.words) == "the paragraph of the publication, and non-deterministic folder" and b.noise == {"hyphen"}
    assert not fixed("the non-\ndeterministic folder").noise


def page(k):
    body = ["The manual describes how every section and folder", "are kept in a common library for every careful", "reader and the paragraph of this manual describes", "how the section is kept."]
    return "\n".join(["Zukosa manual rules | rev. 4", *body, f"- {k} -", "For official use only"])


def test_furniture_and_pages(frame):
    rows = [("d", k, f"d-{k}", 0, k + 1, page(k + 1)) for k in range(40)]
    rows += [("e", 0, "e-0", 0, 1, "the folder of the para-"), ("e", 1, "e-1", 0, 2, "graph and the section."), ("e", 1, "e-1", 0, 2, "graph and the section."), ("f", None, "f", None, None, None), ("f", None, "g", None, None, "")]
    got = {r["block_id"]: r for r in sr.repair(frame(rows, BLOCK).selectExpr("*", "1 as own", "2 as stretch"), lexicon()).collect()}
    assert len(got) == 44
    for k in range(40):
        assert got[f"d-{k}"]["noise"] == ["header", "pageno"] and got[f"d-{k}"]["text"].endswith("section is kept.")
    assert got["e-0"]["text"] == "the folder of the paragraph" and got["e-1"]["text"] == "and the section."
    assert got["e-0"]["noise"] == ["hyphen"] and got["e-1"]["paragraph_id"] == "e-0" and got["f"]["text"] == ""


def test_learn(frame):
    texts = frame([("the folder of the library is kept in the section.",)] * 60 + [("the fo1der is kept.",), (None,), ("",)], "text string")
    lex = sr.learn(texts, least=5)
    assert lex.counts["folder"] == 60 and "fo" not in lex.counts and lex.vectors.shape[0] == len(lex.index)
    assert lex.links("fo1der") == ["folder"]
    empty = sr.learn(texts.limit(0))
    assert not empty.counts and sr.repair(frame([], BLOCK), empty).count() == 0


def test_context_chooses():
    lex = sr.Lexicon({"modern": 100, "modem": 100, "town": 100}, {"modern": 0, "modem": 1, "town": 2})
    import numpy as np

    lex.vectors = np.array([[1.0, 0], [0, 1], [1, 1]], np.float32)
    lex.contexts = np.array([[0, 0], [0, 0], [5, 0]], np.float32)
    assert lex.best(["modem", "modern"], ["town"]) == "modern" and lex.best(["modem", "modern"], []) == "modem"


def test_chunks_of_both_roles_and_any_type(frame):
    from foliospark.llm import queries

    grid = "| folder | reader |\n| --- | --- |\n| common | para- |"
    rows = [("p", "d", "parent", "text", "pdf", 0, 1, "the folder of the para-\ngraph is kept."), ("c", "d", "child", "table", "pdf", 1, 1, "the folder of the para-"), ("t", "d", "child", "table", "pdf", 2, 1, grid), ("c2", "d", "child", "text", "pdf", 3, 1, "graph is kept."), ("s", "e", "child", "row", "csv", 0, None, "a | b")]
    chunks = frame(rows, "chunk_id string, doc_id string, role string, block_type string, file_type string, chunk_seq int, page int, text string")
    got = {r["chunk_id"]: (r["noise"], r["text"]) for r in queries._repaired_chunks(chunks, lexicon()).collect()}
    assert got == {"p": (["hyphen"], "the folder of the paragraph is kept."), "c": (["hyphen"], "the folder of the paragraph"), "t": ([], grid), "c2": ([], "is kept.")}


def test_over_window_starts(frame):
    rows = [("d", 15, "a", 0, 1, "the folder of the para-"), ("d", 16, "x", 0, 2, " "), ("d", 33, "b", 0, 3, "graph and the section"), ("d", 49, "c", 0, 4, "of this manual."), ("d", 50, "e", 0, 5, "the reader")]
    got = {r["block_id"]: (r["paragraph_id"], r["noise"], r["text"]) for r in sr.repair(frame(rows, BLOCK), lexicon()).collect()}
    assert got == {
        "a": ("a", ["hyphen"], "the folder of the paragraph"), "x": ("a", [], ""), "b": ("a", [], "and the section"), "c": ("a", [], "of this manual."), "e": ("e", [], "the reader"),
    }


def test_header_recurs_in_another_window(frame):
    body = ["The manual describes how every section and folder,", "are kept in a common library for every careful,", "reader and the paragraph of this manual."]
    rows = [("d", k, f"d-{k}", 0, 1, "\n".join(["library of the careful reader", f"{w}, the", *body])) for k, w in ((3, "Folder"), (40, "Section"))]
    got = {r["block_id"]: r["noise"] for r in sr.repair(frame(rows, BLOCK), lexicon()).collect()}
    assert got == {"d-3": ["header"], "d-40": ["header"]}


def test_long_sections_stay_in_order(frame):
    rows = [("d", 0, "a", 2047, 1, "the folder of the para-"), ("d", 0, "b", 2048, 1, "graph of the sec-"), ("d", 1, "c", 0, 1, "tion.")]
    got = {r["block_id"]: (r["paragraph_id"], r["text"]) for r in sr.repair(frame(rows, BLOCK), lexicon()).collect()}
    assert got == {"a": ("a", "the folder of the paragraph"), "b": ("a", "of the section."), "c": ("c", "")}


def tokens(n, *words):
    return [(" ".join([w] * 1),) for w in words for _ in range(n)]


def repaired(frame, lex, *texts):
    rows = [("d", k, f"b{k}", 0, 1, t) for k, t in enumerate(texts)]
    return [r["text"] for r in sr.repair(frame(rows, BLOCK), lex).orderBy("sec_idx").collect()]


def test_no_word_is_too_rare(frame):
    # the core holds one word in 20 only: the others' counts and links come from the table of all words
    texts = frame(tokens(1100, "modern", "plain") + tokens(50, "modem", "library") + tokens(1, "1ibrary"), "text string")
    lex = sr.learn(texts, share=5)
    assert set(lex.counts) == {"modern", "plain"}
    assert repaired(frame, lex, "the modem of the 1ibrary", "a moclern 1ibrarv") == ["the modem of the library", "a modern 1ibrarv"]
    # the same texts a hundred times say the same
    again = sr.learn(frame([(" ".join([t] * 100),) for (t,) in map(tuple, texts.collect())], "text string"), share=5)
    assert repaired(frame, again, "the modem of the library") == ["the modem of the library"]


def test_vectors_decide_links(frame):
    lines = [("open the folder of paper now",)] * 80 + [(" ".join(f"{chr(97 + k)}{c}x" for c in "klmnop"),) for k in range(20)] * 40
    lex = sr.learn(frame(lines, "text string"))
    assert repaired(frame, lex, "open the fo1der of paper") == ["open the folder of paper"]
    lex.vectors = -lex.vectors
    assert repaired(frame, lex, "open the fo1der of paper") == ["open the fo1der of paper"]


def test_strokes_survive_edits(frame):
    pairs = frame([(a, b) for a, b in sr.LOOKALIKES] + [("x" + a + "y", "X" + b + "Y") for a, b in sr.LOOKALIKES], "a string, b string")
    assert pairs.filter(sr.strokes(pairs.a) != sr.strokes(pairs.b)).count() == 0


def test_lost_halves_are_not_glued():
    b = fixed("the folder of the sec-\nThe reader")
    assert " ".join(b.words) == "the folder of the sec- The reader" and b.noise == {"hyphen"}


def test_shapes_of_edge_lines(frame):
    body = "The manual describes\nhow every section is kept\nin a common library\nfor every careful reader\nof this manual."
    lex = sr.learn(frame([(f"{body}\nQX-{k}/{k % 9}",) for k in range(60)] + [("A list of\n12 May\nand more\nlines in it\nand more\n13 May\nin the end\nof the text\nfor good",)] * 9, "text string"))
    assert "A-9/9" in lex.shapes and "9 A" not in lex.shapes
    assert sr.shape("plain words") is None and sr.shape("version 12") is None
