import random
import re

from foliospark.llm import near_duplicates as nd

HOW = nd.Similarity(words=3, threshold=0.5, least=10)


def corpus(seed=1, groups=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    out = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(60)]
        for v in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text.insert(rng.randrange(60), rng.choice(words))
            out.append((f"{g:03}-{v}", f"uri{v}", " ".join(text)))
    return out


def shingles(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(rows, how):
    sets = {i: shingles(t or "", how.words) for i, _, t in rows}
    own = {i: o for i, o, _ in rows}
    ids = sorted(i for i in sets if len(sets[i]) >= how.least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if own[a] != own[b] and len(sets[a] & sets[b]) >= how.threshold * len(sets[a] | sets[b])}


def found(frame, rows, how, extra=""):
    return {tuple(r) for r in nd.pairs(nd.near(frame(rows, "id string, owner string, text string" + extra), how)).collect()}


def test_like_brute_force(frame):
    rows = corpus()
    rows += rows[:5]  # repeated rows
    assert found(frame, rows, HOW) == brute(rows, HOW) != set()


def test_long_lists_are_split_not_cut(frame):
    rows = corpus(2, 15)
    how = nd.Similarity(words=3, threshold=0.5, least=10, long_list=2)
    assert found(frame, rows, how) == brute(rows, how)


def test_odd_rows(frame):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [("a", "u", None, 1), ("b", "v", "", 1), ("c", None, text, 1), ("d", "u", text, 1), ("e", "v", text.upper() + "!", 1), ("f", "w", "two words", 1), ("g", "z", " ".join(f"y{k}" for k in range(200_000)), 1)]
    assert found(frame, rows, HOW, ", key int") == {("d", "e")}  # c has no owner, copies differ in case only
    assert found(frame, [], HOW) == set()


def test_groups(frame):
    rows = corpus(3, 12)
    got = {r["id"]: (r["class_id"], r["links"]) for r in nd.groups(nd.near(frame(rows, "id string, owner string, text string"), HOW)).collect()}
    sets = {i: frozenset(shingles(t)) for i, _, t in rows}
    link = {i: {j for j in sets if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])} for i in sets}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] | {j for j in sets if sets[j] == sets[i]}:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (min(seen), len({sets[j] for j in link[i]}))


def test_parameters():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        how = nd.Similarity(threshold=threshold)
        p = threshold**how.width
        assert (1 - p) ** how.entries + how.entries * p * (1 - p) ** (how.entries - 1) <= how.miss


def test_exact_mode_loses_nothing(frame):
    rows = corpus(4, 60)
    for threshold, least in ((0.5, 10), (0.8, 1)):
        for long_list in (1000, 2):
            how = nd.Similarity(words=2, threshold=threshold, least=least, exact=True, long_list=long_list)
            assert found(frame, rows, how) == brute(rows, how) != set()
    tiny = [("a", "u", "one two three"), ("b", "v", "one two three four"), ("c", "w", "x y z"), ("d", "u", "one two")]
    how = nd.Similarity(words=2, threshold=0.5, exact=True)
    assert found(frame, tiny, how) == brute(tiny, how) == {("a", "b"), ("a", "d")} - {("a", "d")}


def test_one_large_family(frame):
    # one text in 300 slightly different forms: every entry is hot, and lists are dealt to parts
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for v in range(150):
        text = list(base)
        text[rng.randrange(60)] = f"v{v}"
        rows.append((f"{v:03}", f"uri{v % 7}", " ".join(text)))
    how = nd.Similarity(words=3, threshold=0.5, least=10, long_list=20)
    assert found(frame, rows, how) == brute(rows, how)
    assert {r["class_id"] for r in nd.groups(nd.near(frame(rows, "id string, owner string, text string"), how)).collect()} == {"000"}
