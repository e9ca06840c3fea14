import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.operators import semantic


@pytest.mark.parametrize("kind,amount", [("percentile", 80.0), ("standard_deviation", 1.0), ("interquartile", 0.5), ("gradient", 80.0)])
def test_within_a_row_as_over_rows(spark, kind, amount):
    rng = random.Random(3)
    lists = [[rng.random() for _ in range(n)] for n in (1, 2, 3, 5, 17, 40)]
    rows = [(str(k), i, x) for k, xs in enumerate(lists) for i, x in enumerate(xs)]
    over = semantic.breaks(spark.createDataFrame(rows, "k string, i int, distance double"), ["k"], "i", kind, amount).collect()
    cut = {(r["k"], r["i"]) for r in over if r["cut"]}
    df = spark.createDataFrame([(str(k), xs) for k, xs in enumerate([*lists, []])], "k string, d array<double>")
    for r in df.select("k", semantic.array_breaks(F.col("d"), kind, amount).alias("s")).collect():
        assert r["s"] == [1, *sorted(i + 2 for k, i in cut if k == r["k"])]


def test_native_and_other_models_alike(spark):
    texts = spark.createDataFrame([("a", "One is here. Two is there! Three? Four, at last. Five follows. Six ends."), ("b", "Only one"), ("c", "")], "parent_id string, text string")

    def other(text):
        return F.udf(semantic.hashed_vector, "array<double>")(text)

    cfg = Settings(breakpoint_threshold_amount=50.0)
    got = [sorted(map(tuple, semantic.splitter(e)(texts, cfg).collect())) for e in (semantic.hashed, other)]
    assert got[0] == got[1] and len(got[0]) > 3
    assert " ".join(t for k, _, t in got[0] if k == "a") == "One is here. Two is there! Three? Four, at last. Five follows. Six ends."
    with pytest.raises(ValueError, match="unknown kind"):
        semantic.array_breaks(F.lit(0), "none")
