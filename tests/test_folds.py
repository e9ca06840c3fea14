import random

from pyspark.sql import functions as F

from foliospark.functions import folds


def before(sizes, limit):
    out, g, total = [], -1, 0
    for n in sizes:
        if g >= 0 and total + n <= limit:
            total += n
        else:
            g, total = g + 1, n
        out.append(g)
    return out


def after(sizes, target, most):
    out, g, k, total = [], 0, 0, 0
    for n in sizes:
        out.append(g)
        k, total = k + 1, total + n
        if k >= most or total >= target:
            g, k, total = g + 1, 0, 0
    return out


def closes_at(sizes, least):
    """How many items of a group it takes to reach ``least``."""
    return next((k for k in range(1, len(sizes) + 1) if sum(sizes[:k]) >= least), len(sizes))


def is_small_merge(sizes, ids, least):
    """Groups follow one another and close at once on reaching the least; what the last holds beyond that
    is a rest too small to be a group."""
    groups = [[n for n, g in zip(sizes, ids) if g == k] for k in sorted(set(ids))]
    in_order = list(ids) == sorted(ids) and sorted(set(ids)) == list(range(len(groups)))
    closed = all(sum(g) >= least and closes_at(g, least) == len(g) for g in groups[:-1])
    last = groups[-1] if groups else []
    return in_order and closed and sum(last[closes_at(last, least) :]) < least and (len(groups) < 2 or sum(last) >= least)


def path(heads, i):
    """A heading's path is that of the nearest earlier one of a lower level, and itself."""
    above = [j for j in range(i) if heads[j][0] < heads[i][0]]
    return [*(path(heads, above[-1]) if above else []), heads[i][1]]


def test_packers_like_loops(spark):
    rng = random.Random(2)
    lists = [[rng.randint(0, 9) for _ in range(rng.randint(0, 25))] for _ in range(120)]
    df = spark.createDataFrame([(x,) for x in lists], "n array<bigint>")
    rows = df.select("n", folds.pack_before("n", 10).alias("b"), folds.pack_after("n", 12, 4).alias("a"), folds.merge_small("n", 6).alias("m")).collect()
    for r in rows:
        assert list(r["b"]) == before(r["n"], 10)
        assert list(r["a"]) == after(r["n"], 12, 4)
        assert is_small_merge(r["n"], r["m"], 6)


def test_worked_packs(spark):
    df = spark.createDataFrame([([3, 3, 1, 1, 6], [3, 3, 1, 1, 1, 2])], "p array<bigint>, r array<bigint>")
    r = df.select(folds.pack_before("p", 5).alias("p"), folds.pack_after("r", 5, 10).alias("r")).first()
    assert list(r["p"]) == [0, 1, 1, 1, 2] and list(r["r"]) == [0, 0, 1, 1, 1, 1]


def test_carry_and_headings(spark):
    df = spark.createDataFrame([([(5, False), (60, False), (50, True), (1, False)],)], "i array<struct<n:bigint,tb:boolean>>")
    assert list(df.select(folds.carry_short("i", 50).alias("x")).first()["x"]) == [0, 0, 1, 2]
    rng = random.Random(3)
    cases = [[(rng.randint(1, 4), f"h{k}") for k in range(rng.randint(0, 12))] for _ in range(40)] + [[(1, "h1"), (2, "h2"), (3, "h3"), (2, "h4"), (1, "h5")]]
    df = spark.createDataFrame([(c,) for c in cases], "h array<struct<l:int,x:string>>")
    for r in df.select("h", folds.heading_paths("h").alias("p")).collect():
        heads = [(h["l"], h["x"]) for h in r["h"]]
        assert [list(p) for p in r["p"]] == [path(heads, i) for i in range(len(heads))]


def test_starts_like_groups(spark):
    rng = random.Random(3)
    lists = [[rng.randint(0, 9) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in lists], "n array<bigint>").withColumn("s", folds.starts_before("n", 10))
    for r in df.select("n", "s", folds.cut(F.col("n"), F.col("s")).alias("parts")).collect():
        groups = before(r["n"], 10)
        assert list(r["s"]) == [k + 1 for k, g in enumerate(groups) if not k or g != groups[k - 1]]
        assert [x for part in r["parts"] for x in part] == list(r["n"]) and len(r["parts"]) == len(set(groups))
