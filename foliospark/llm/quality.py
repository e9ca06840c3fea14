"""Statistics of a text that tell prose from lists, tables and junk, and the rules that do.

The statistics are native columns. A rule list over them is induced on a bounded sample of labelled
texts (``most_labels``) and applied as a SQL CASE expression to all texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.rules import induce
from foliospark.workspace import materialize

# What starts an item of a list; vowels of the languages in Latin script.
ITEM = r"^\s*([-*+•◦▪‣☐☑✓–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s"
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüãõåæø"

STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "vowel_ratio", "closed_line_share", "mean_line_words", "item_share",
    "column_share", "leader_share", "numbered_end_share", "separators_per_word", "markup_per_word", "long_word_share", "distinct_share",
    "common_share", "sentence_ends_per_word", "number_word_share",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_statistics(texts: DataFrame, text: str, common: list[str]) -> DataFrame:
    """``texts`` with the columns of ``STATISTICS``; a null text counts as an empty one (all 0).

    ``common`` are lower-case words. Columns of ``texts`` of the same names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = texts.withColumns({
        "_t": t,
        "_words": F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, r"[\r\n]+"), lambda x: F.trim(x) != ""),
        "_tokens": F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""),
    })
    rest = lambda pattern, of="_t": F.length(F.regexp_replace(of, pattern, "")).cast("double")
    counted = base.withColumns({
        "_distinct": F.array_distinct("_words"),
        "_n": F.size("_tokens").cast("double"),
        # characters are counted by removing the runs of all others: few matches in most texts
        "_chars": rest(r"(?U)\s+"),
        "_symbols": rest(r"(?U)[\p{L}\p{M}0-9\s]+"),
        "_digits": rest("[^0-9]+"),
        "_line_chars": F.aggregate("_lines", F.lit(0), lambda a, x: a + F.length(x)).cast("double"),
        "_many": F.size("_lines").cast("double"),
    })
    chars_of = lambda holds: F.aggregate("_lines", F.lit(0), lambda a, x: a + F.when(holds(x), F.length(x)).otherwise(0)).cast("double")
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("double")
    marks = lambda x: F.regexp_count(x, F.lit(r"[|\t;]"))
    counted = counted.withColumn("_all", F.array_join("_words", "")).withColumns({
        "_vowels": F.length("_all") - F.length(F.translate("_all", VOWELS, "")), "_latin": F.length("_all") - rest("[a-zà-ɏ]+", "_all"),
    })
    out = counted.withColumns({
        "n_words": F.col("_n"),
        "mean_word_length": _share(F.col("_chars"), F.col("_n")),
        "symbol_ratio": _share(F.col("_symbols"), F.col("_chars")),
        "digit_ratio": _share(F.col("_digits"), F.col("_chars")),
        # of letters in Latin script; words that are mostly in others count as natural
        "vowel_ratio": F.when(F.col("_latin") * 2 > F.length("_all"), F.col("_vowels") / F.col("_latin")).otherwise(F.lit(0.4)),
        "closed_line_share": _share(F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"[.!?:;…。]$"))).cast("double"), F.col("_many")),
        "mean_line_words": _share(F.col("_n"), F.col("_many")),
        "item_share": _share(chars_of(lambda x: x.rlike(ITEM)), F.col("_line_chars")),
        "column_share": _share(chars_of(lambda x: (marks(x) >= 2) & (marks(x) * 40 >= F.length(x))), F.col("_line_chars")),
        "leader_share": _share(chars_of(lambda x: x.rlike(r"\.{4}|_{4}|-{6}|~{4}|#{6}|={4}")), F.col("_line_chars")),
        "numbered_end_share": _share(chars_of(lambda x: x.rlike(r"[\d)]\s*$")), F.col("_line_chars")),
        "separators_per_word": _share(rest(r"[^|\t;]+"), F.col("_n")),
        "markup_per_word": _share(count(r"</?[A-Za-z]|[{}\[\]=]|&[a-z]+;"), F.col("_n")),
        "long_word_share": _share(F.size(F.filter("_tokens", lambda w: F.length(w) > 24)).cast("double"), F.col("_n")),
        "distinct_share": _share(F.size("_distinct").cast("double"), F.size("_words").cast("double")),
        "common_share": _share(F.size(F.array_intersect("_distinct", F.array(*map(F.lit, common)) if common else F.array().cast("array<string>"))).cast("double"), F.size("_distinct").cast("double")),
        "sentence_ends_per_word": _share(count(r"\p{L}{2}[)\"'”]?[.!?…](?=\s|$)"), F.col("_n")),
        "number_word_share": _share(F.size(F.filter("_tokens", lambda w: w.rlike(r"\d"))).cast("double"), F.col("_n")),
    })
    return out.drop("_t", "_words", "_lines", "_tokens", "_distinct", "_n", "_chars", "_symbols", "_digits", "_all", "_vowels", "_latin", "_line_chars", "_many")


def labelled(texts: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """``(id, text, label)``: the label given most often to a text; ties and null labels are left out.

    At most ``most_labels`` texts, chosen by a hash of their id.
    """
    votes = labels.filter("label is not null and id is not null").distinct().groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    won = votes.groupBy("id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "label")).alias("v"))
    won = won.select("id", F.expr("transform(filter(v, x -> x.n = top), x -> x.label)").alias("w")).filter("size(w) = 1").select("id", F.col("w")[0].alias("label"))
    won = won.orderBy(F.xxhash64("id"), "id").limit(most_labels)
    # at most most_labels rows, so the texts aren't shuffled for them
    return texts.select("id", "text").filter("text is not null").join(F.broadcast(won), "id").dropDuplicates(["id"])


def common_words(cases: DataFrame, usual: str = "prose", most: int = 500, least_rate: float = 3.0) -> list[str]:
    """Words that mark the texts of ``cases(text, label)`` labelled ``usual``: the most frequent of those
    that are at least ``least_rate`` times as frequent in them as in the others."""
    here = F.col("label") == usual
    size = cases.agg(F.count_if(here).alias("usual"), F.count_if(~here).alias("other")).first()
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    counts = cases.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.count_if(here).alias("there"), F.count_if(~here).alias("other"))
    rate = (F.col("there") / max(1, size["usual"])) / ((F.col("other") + 1) / (size["other"] + 2))
    kept = counts.filter((F.col("there") >= 3) & (rate >= least_rate)).orderBy(F.col("there").desc(), "word").limit(most)
    return [r["word"] for r in kept.collect()]


def learn(texts: DataFrame, labels: DataFrame, most_labels: int = 20_000, usual: str = "prose") -> tuple[str, list[str]]:
    """From ``labels(id, label)`` of ``texts(id, text)``: a SQL CASE expression over the statistics
    that gives a text's kind, and the common words the statistics need.

    Two rule lists: one for whatever isn't ``usual``, one that tells the other kinds apart. Without
    labelled texts everything is ``usual``. Texts stay on executors; their statistics, a row of numbers
    for each of at most ``most_labels``, come to the driver.
    """
    cases = materialize(labelled(texts, labels, most_labels), "quality-cases")
    common = common_words(cases, usual, least_rate=1.0)
    for clean in (True, False):
        rows = with_statistics(cases, "text", common).select("id", "label", *STATISTICS).orderBy("id").toPandas()
        if not len(rows):
            return f"'{usual}'", []
        kinds = rows["label"].to_numpy(object)
        columns = {c: rows[c].to_numpy(float) for c in STATISTICS}
        other = induce(columns, np.where(kinds == usual, usual, "other"), usual)
        if clean:  # wrong labels blur which words are common: those that no rule bears out are left out
            agreed = rows[["id"]][(kinds == usual) == (other.predict(columns) == usual)]
            right = texts.sparkSession.createDataFrame(agreed, texts.select("id").schema)  # at most most_labels rows
            common = common_words(cases.join(F.broadcast(right), "id", "left_semi"), usual)
    caught = (other.predict(columns) != usual) & (kinds != usual)
    if not caught.any():
        return f"'{usual}'", common
    names, counts = np.unique(kinds[caught], return_counts=True)
    apart = induce({c: x[caught] for c, x in columns.items()}, kinds[caught], names[np.argmax(counts)])
    return f"CASE WHEN {other.conditions()} THEN {apart.case()} ELSE '{usual}' END", common


def classify(texts: DataFrame, text: str, case: str, common: list[str], out: str = "kind") -> DataFrame:
    """``texts`` with the statistics and the column ``out``, what the rules say."""
    return with_statistics(texts, text, common).withColumn(out, F.expr(case))
