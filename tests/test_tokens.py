import pytest
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import text as t
from foliospark.functions import tokens
from foliospark.operators import ladder, prose

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_choice():
    assert tokens.backend(Settings()) == ("whitespace", None)
    assert tokens.backend(Settings(token_counter="auto", token_encoder_model="f"))[0] == "hf"
    assert tokens.backend(Settings(token_counter="auto", embedding_provider="openai", token_encoder_model="f"))[0] == "tiktoken"
    for bad in (Settings(token_counter="x"), Settings(token_counter="hf")):
        with pytest.raises(ValueError):
            tokens.backend(bad)


def test_vocabulary_counter(spark):
    cfg = Settings(token_counter="tiktoken", token_encoder_model=RANKS, max_parent_tokens=30, max_child_tokens=12, min_child_tokens=3)
    text = "\n\n".join(f"Paragraph number {k} has uncommonly tokenized words." for k in range(12))
    df = spark.createDataFrame([("d", 0, text), ("e", 0, None)], "doc_id string, sec_idx int, text string")
    with tokens.using(cfg):
        sizes = [r["n"] for r in df.select(t.token_count(F.col("text")).alias("n")).collect()]
        parts = prose.paragraph_parts(df.filter("text is not null"), cfg).collect()
        cut = df.limit(1).select(prose.recursive_split(F.col("text"), 12).alias("x")).first()["x"]
    of = tokens.counter("tiktoken", RANKS)
    assert sizes == [of(text), 0] and tokens.is_native()
    assert len(parts) > 1 and sum(r["text"].count("Paragraph") for r in parts) == 12
    assert all(of(x) <= 12 for x in cut) and "".join("".join(cut).split()) == "".join(text.split())


def test_python_split_like_native(spark):
    text = "\n\n".join("a b c d e f g"[: 2 * k] + "\nmore words here" for k in range(1, 9))
    native = spark.createDataFrame([(text,)], "s string").select(prose.recursive_split(F.col("s"), 5).alias("x")).first()["x"]
    assert [x.split() for x in native] == [x.split() for x in prose.split_recursively(text, 5, lambda s: len(s.split()))]


def test_classifier_failures_are_no_answers(spark):
    df = spark.createDataFrame([("[]",), (None,)], "p string")

    def broken(prompt):
        raise OSError("no network")

    assert [r["a"] for r in df.select(ladder.asking(broken)(F.col("p")).alias("a")).collect()] == [None, None]
    assert df.select(ladder.asking(lambda p: p[-2:])(F.col("p")).alias("a")).first()["a"] == "[]"
