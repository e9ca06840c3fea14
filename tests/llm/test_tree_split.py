import random

from foliospark.llm import tree_split as ts

LIMITS = "item_kind string, max_tokens int, overlap_tokens int"


def test_pieces_cover_and_fit():
    rng = random.Random(1)
    for _ in range(150):
        words = [rng.choice(["alpha", "beta.", "gamma,", "- item", "# Head", "9.1 Title", "delta"]) for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\n\n", "\xa0"]) for w in words)
        limit, overlap = rng.randint(1, 30), rng.randint(0, 12)
        pieces = ts.split_text(text, limit, overlap)
        tokens = ts._TOKEN.findall(text)
        again = []
        for piece, n, shared, _ in pieces:
            own = ts._TOKEN.findall(piece)
            assert len(own) == n <= limit
            assert shared == min(max(0, min(overlap, limit - 1)), len(again)) and (not shared or own[:shared] == again[-shared:])
            again += own[shared:]
        assert again == tokens


def test_natural_boundaries():
    text = "# A\n\nOne two three four.\n\nFive six seven eight.\n\n# B\n\nNine ten."
    assert [p[0] for p in ts.split_text(text, 12, 0)] == ["# A\n\nOne two three four.\n\nFive six seven eight.", "# B\n\nNine ten."]
    assert [p[3] for p in ts.split_text("a b c. d e f. g", 3, 0)] == ["start", "sentence", "sentence"]


def test_tables():
    rows = [["h", "k"], ["a b c d e f g h i j", "x"], None, ["1", None, "extra"], ["2", "3"]]
    pieces = ts.split_table(rows, 6)
    assert all(sum(ts._cells(sum(p[0], []))) == p[1] <= 6 and p[0][0] == ["h", "k"] for p in pieces)
    assert [w for p in pieces for r in p[0][1:] for c in r if c for w in c.split()] == "a b c d e f g h i j x 1 extra 2 3".split()
    assert ts.split_table([], 5) == [] and ts.split_table(None, 5) == []
    assert [p[1] for p in ts.split_table([["a b c d e f"], ["g"]], 4)] == [4, 3]  # header too large to repeat


def test_operator(frame):
    limits = frame([("t", 5, 2), ("s", 6, 1)], LIMITS)
    texts = frame([("t", "x", "one two three four five six seven", 9), ("t", "x", "one two three four five six seven", 9), ("t", "y", "short", 9), ("t", "n", None, 9), ("other", "z", "a b c d e f g", 9), (None, None, "q", 9)], "item_kind string, item_id string, text string, span int")
    got = ts.split(ts.texts_to_split(texts, limits)).orderBy("piece_no").collect()
    assert {r["item_id"] for r in got} == {"x"} and [r["piece_no"] for r in got] == [0, 1]
    blocks = frame([("d", f"b{k}", k, "w " * 3 + f"end{k}.") for k in range(300)] + [("d", "b0", 0, "w w w end0."), ("e", "c", 0, None)], "item_id string, block_id string, place int, text string")
    got = ts.split(ts.blocks_to_split(blocks, limits, "s")).orderBy("piece_no").collect()
    own = [w for r in got for w in r["text"].split()[r["shared_tokens"] :]]
    assert own == [w for k in range(300) for w in f"w w w end{k}.".split()] and all(r["tokens"] <= 6 for r in got)
    assert [r["piece_no"] for r in got] == list(range(len(got)))
    tabs = frame([("s", "t1", [["a"], ["b c d e f g h"]])], "item_kind string, item_id string, table_rows array<array<string>>")
    assert ts.split(ts.tables_to_split(tabs, limits)).count() == 2
    assert ts.split(ts.texts_to_split(texts.limit(0), limits)).count() == 0


def test_depths_are_levels_of_the_tree():
    part = lambda head, n: f"{head}\n\n" + " ".join(["word"] * n) + ".\n\n"
    text = part("# A", 3) + part("## A1", 8) + part("## A2", 8) + part("# B", 3) + part("## B1", 3)
    pieces = [p[0].split("\n")[0] for p in ts.split_text(text, 16, 0)]
    assert pieces == ["# A", "## A2", "# B"]  # B isn't begun in the piece that ends A, its own parts are together
    text = part("1.1 One", 2) + part("1.1.1 Deep", 9) + part("1.1.2 Deep", 9) + part("1.2 Two", 2)
    assert [p[0].split("\n")[0] for p in ts.split_text(text, 15, 0)] == ["1.1 One", "1.1.2 Deep", "1.2 Two"]


def test_nested_lists_and_markup():
    text = "- one a\n  - two b\n  - two c\n- one d\n  - two e\n  - two f"
    assert [p[0] for p in ts.split_text(text, 9, 0)] == ["- one a\n  - two b\n  - two c", "- one d\n  - two e\n  - two f"]
    text = "<ul> <li> <p>a b</p> <p>c d</p> </li> <li> <p>e f</p> <p>g h</p> </li> </ul>"
    got = ts.split_text(text, 8, 0)
    assert any(p[0].startswith("<li> <p>e") for p in got) and all(p[1] <= 8 for p in got)
    assert got[-1][3] == "element"


def test_header_is_repeated_while_it_fits():
    pieces = ts.split_table([["a b c"], ["d e f"]], 4)
    assert [p[0] for p in pieces] == [[["a b c"], [w]] for w in "def"]


def test_spans_lead_in_with_the_whole_overlap(frame):
    limits = frame([("s", 10, 4)], LIMITS)
    blocks = frame([("d", f"b{k:05}", k if k < 3990 else None, f"w{k}") for k in range(4000)] + [("d", "empty", 700, None)], "item_id string, block_id string, place int, text string")
    got = ts.split(ts.blocks_to_split(blocks, limits, "s")).orderBy("piece_no").collect()
    assert [r["shared_tokens"] for r in got] == [0] + [4] * (len(got) - 1) and [r["piece_no"] for r in got] == list(range(len(got)))
    assert [w for r in got for w in r["text"].split()[r["shared_tokens"] :]] == [f"w{k}" for k in range(4000)]
    for a, b in zip(got, got[1:]):
        assert a["text"].split()[-4:] == b["text"].split()[:4]
    assert ts.blocks_to_split(blocks, limits, "s").agg({"span": "max"}).first()[0] >= 6
    assert ts.split(ts.blocks_to_split(blocks, frame([], LIMITS), "s")).count() == 0
