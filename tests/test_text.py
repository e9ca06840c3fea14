import random

from pyspark.sql import functions as F

from foliospark.config import Settings, offline_conf
from foliospark.functions import text as t


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in TYPES.items() if k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


TYPES = {"s": "string", "a": "array<string>", "g": "array<array<string>>", "n": "double"}


def test_worked_identifiers(spark):
    assert one(spark, t.doc_id(F.lit("file:///x.pdf"), F.lit("1234.5"))) == "fc7e8651ead7eb72"
    path = F.array(F.lit("A"), F.lit("B"))
    assert one(spark, t.chunk_id(F.lit("testdoc"), path, F.lit("child"), F.lit(0), F.lit("text"))) == "0eeb2c8a9379079f"
    empty = F.array().cast("array<string>")
    assert one(spark, t.chunk_id(F.lit("testdoc"), empty, F.lit("parent"), F.lit(-1), F.lit("document-root"))) == "106065181205feb5"


def test_markdown(spark):
    assert one(spark, t.grid_to_markdown(F.col("g")), g=[["a|b", "c"], ["1"]]) == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert one(spark, t.grid_to_markdown(F.col("g")), g=[]) == ""
    assert one(spark, t.grid_to_markdown(F.col("g"), has_header=False), g=[["1", None]]).startswith("| col_0 | col_1 |")
    assert one(spark, t.grid_to_markdown(F.col("g")), g=[["a"], None]) == "| a |\n| --- |\n|  |"


def test_strip_and_lines_like_python(spark):
    rng = random.Random(1)
    marks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x85", " ", " ", "\xa0", "　", "a", "bc"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", t.strip(F.col("s")).alias("p"), t.split_lines(F.col("s")).alias("l"))
    for r in df.collect():
        assert r["p"] == r["s"].strip()
        assert list(r["l"]) == r["s"].splitlines()


def test_numbers_like_python(spark):
    cells = ["1", "-1.5", "1_000", "1__0", "nan", "inf", "1e5", "1d", ".5", "5.", "", "x", " 7 ", "--5", "+3"]

    def python(x):
        try:
            float(x)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in cells], "s string").select("s", t.is_numeric(F.col("s")).alias("n"), t.is_integer(F.col("s")).alias("i"))
    for r in df.collect():
        assert r["n"] == python(r["s"]), r
        assert r["i"] == r["s"].lstrip("-").isdigit(), r


def test_parts(spark):
    assert one(spark, t.with_part(F.col("a"), F.lit(1), F.lit(2)), a=["x", "y"]) == ["x", "y (part 1/2)"]
    assert one(spark, t.with_part(F.col("a"), F.lit(2), F.lit(2)), a=[]) == ["(part 2/2)"]
    assert one(spark, t.with_part(F.col("a"), F.lit(1), F.lit(1)), a=["x"]) == ["x"]
    assert one(spark, t.with_table_part(F.col("a"), F.lit(1), F.lit(1)), a=["x"]) == ["x", "(table part 1/1)"]
    assert one(spark, t.coerce_number(F.col("n")), n=3.0) == "3"
    assert one(spark, t.coerce_number(F.col("n")), n=float("nan")) == ""
    assert one(spark, t.token_count(F.col("s")), s=None) == 0


def test_settings():
    assert Settings.from_env({"FOLIO_MAX_CHILD_TOKENS": "7", "FOLIO_OFFLINE": "true", "OTHER": "1"}).max_child_tokens == 7
    try:
        Settings(offline=True, embedding_provider="azure_openai")
        raise AssertionError
    except ValueError:
        pass
    assert "spark.executorEnv.HF_HUB_OFFLINE" not in offline_conf({"spark.executorEnv.HF_HUB_OFFLINE": "0"})
