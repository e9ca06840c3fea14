import random

from pyspark.sql import functions as F

from foliospark.operators import order
from foliospark.operators.order import numbered, running_sum


def test_like_a_loop_over_stretches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abh"), rng.choice([None, *range(60)]), k, rng.randint(0, 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, p int, k int, v int")
    by = [F.col("p").asc_nulls_last(), "k"]
    got = numbered(running_sum(df, ["g"], "p", by, F.col("v"), "s", width=7), ["g"], "p", by, "n", width=7).collect()
    for g in "abh":
        total = 0
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["p"] is None, r["p"] or 0, r["k"]))
        for n, r in enumerate(mine):
            total += r["v"]
            assert (r["n"], r["s"]) == (n, total)
    assert len(got) == 500


def test_neighbours_over_stretches(spark):
    rng = random.Random(5)
    rows = [(d, at, f"{d}{at}") for d in "ab" for at in rng.sample(range(3000), 40)]
    df = spark.createDataFrame(rows, "d string, at int, x string")
    got = order.with_neighbours(df, ["d"], "at", ["at"], F.col("x"), F.upper("x"), "p", "n", width=16).collect()
    for d in "ab":
        mine = sorted((r for r in got if r["d"] == d), key=lambda r: r["at"])
        assert [r["p"] for r in mine] == [None, *[r["x"].upper() for r in mine[:-1]]]
        assert [r["n"] for r in mine] == [*[r["x"] for r in mine[1:]], None]
