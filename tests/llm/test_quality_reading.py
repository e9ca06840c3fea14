import random

import numpy as np

from foliospark.llm import quality as ql
from foliospark.llm import reading as rd
from foliospark.llm.rules import RuleList, induce

PROSE = "the report that was kept in a box is read by the team and they find it with care"


def cases(seed=1, n=240):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.choice(["prose"] * 5 + ["list", "table", "junk"])
        if kind == "prose":
            text = " ".join((" ".join(rng.choice(PROSE.split()) for _ in range(12)) + ".") for _ in range(6))
        elif kind == "list":
            text = "\n".join(f"- item {rng.randint(1, 99)} thing" for _ in range(14))
        elif kind == "table":
            text = "\n".join(f"{rng.randint(1, 999)};unit;{rng.randint(1, 999)};x" for _ in range(14))
        else:
            text = "".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789+/") for _ in range(300))
        out.append((f"c{k}", text, kind))
    return out


def test_rules_learn_despite_wrong_labels(frame):
    rows = cases()
    rng = random.Random(5)
    labels = [(i, rng.choice(["prose", "list"]) if rng.random() < 0.04 else kind, "a") for i, _, kind in rows] + [("c1", None, "b"), (None, "list", "b"), ("gone", "junk", "b")]
    texts = frame([(i, t) for i, t, _ in rows] + [("n", None), ("e", "")], "id string, text string")
    case, common = ql.learn(texts, frame(labels, "id string, label string, annotator string"))
    fresh = cases(9, 160)
    got = {r["id"]: r["kind"] for r in ql.classify(frame([(i, t) for i, t, _ in fresh], "id string, text string"), "text", case, common).collect()}
    right = sum((got[i] == "prose") == (kind == "prose") for i, _, kind in fresh)
    assert right >= 0.97 * len(fresh)


def test_nothing_to_learn(frame):
    texts = frame([("a", "x"), ("b", None)], "id string, text string")
    case, common = ql.learn(texts, frame([], "id string, label string"))
    assert [r["kind"] for r in ql.classify(texts, "text", case, common).collect()] == ["prose", "prose"]


def test_statistics(frame):
    df = frame([("One two three.\nFour", 7), (None, 7), ("", 7), ("|a|b|\n|c|d|", 7)], "text string, n_words int")
    rows = ql.with_statistics(df, "text", ["one"]).collect()
    assert rows[0]["n_words"] == 4 and rows[0]["closed_line_share"] == 0.5 and rows[0]["common_share"] == 0.25
    assert rows[0]["mean_word_length"] == 16 / 4 and rows[0]["symbol_ratio"] == 1 / 16
    assert all(rows[1][c] == rows[2][c] for c in ql.STATISTICS) and rows[2]["n_words"] == 0
    assert rows[3]["column_share"] == 1


def test_rule_list():
    x = np.r_[np.linspace(0, 1, 200), np.linspace(2, 3, 60)]
    y = np.array(["prose"] * 200 + ["list"] * 60, object)
    rules = induce({"x": x}, y, "prose")
    assert (rules.predict({"x": x}) == y).all() and "CASE WHEN x >= 1.5" in rules.case()
    assert RuleList((), "prose").case() == "'prose'"


def level_texts(seed, n):
    rng = random.Random(seed)
    words = {lv: [f"{'abcde'[lv - 1]}word{'xyzuvw'[k % 6]}{'klmn'[k // 6 % 4]}" for k in range(24)] for lv in range(1, 6)}
    common = ["the", "of", "and", "is"]
    out = []
    for k in range(n):
        lv = rng.randint(1, 5)
        pick = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(words[max(1, min(5, lv + rng.choice([0, 0, 0, -1])))])  # noqa: B023, E731
        out.append((k, "\n".join(" ".join(pick() for _ in range(12)) + "." for _ in range(8)), lv))
    return out


def test_levels(frame):
    fw = frozenset(["the", "of", "and", "is"])
    rows = level_texts(1, 250)
    texts = frame([(k, t) for k, t, _ in rows] + [(1000, None)], "id bigint, text string")
    labels = frame([(k, lv, "g") for k, _, lv in rows] + [(1000, 3, "g"), (1, None, "g"), (2, 99, "g")], "id bigint, level int, grader string")
    model = rd.fit(texts, labels, fw)
    fresh = level_texts(7, 120)
    odd = [(500, None), (501, ""), (502, "1;2;3\n4;5;6"), (503, "unknown " * 80), (504, "the of and is " * 50_000)]
    got = {r["id"]: r for r in rd.levels(frame([(k, t) for k, t, _ in fresh] + odd, "id bigint, text string"), model, fw).collect()}
    assert len(got) == 125 and all(got[k]["is_prose"] for k, _, _ in fresh)
    assert np.mean([abs(got[k]["score"] - lv) for k, _, lv in fresh]) < 0.5
    assert not any(got[k]["is_prose"] for k in (500, 501, 502, 503)) and got[500]["level"] is None


def test_no_graded_texts(frame):
    texts = frame([(1, "some text")], "id bigint, text string")
    model = rd.fit(texts, frame([], "id bigint, level int"), frozenset())
    assert rd.levels(texts, model, frozenset()).first()["level"] is None


def test_long_clauses_raise_nothing():
    g = {w: 1.0 for w in "we put it in the box and then went home".split()}
    model = rd.Model(g, [0.0] * 12 + [1.0])
    short, long = "we put it in the box. " * 10, "we put it in the box and then went home and " * 10
    assert model.level(rd.prose_of(short, g, frozenset(["the"])).words) == model.level(rd.prose_of(long, g, frozenset(["the"])).words) == 1.0
