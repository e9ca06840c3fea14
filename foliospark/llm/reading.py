"""Reading level of a text from the grades at which its words are acquired.

From graded texts each word gets an acquisition grade: the middle of its distribution over grades,
evened out for how many texts of a grade there are. A text's running prose is then described by
quantiles of the grades of its known words, and a linear calibration on the graded texts turns these
into a level. Sentence length takes no part: stringing plain clauses together raises nothing, while
the words that build subordinate clauses have grades like any others.

The model is fitted on at most ``most_labels`` graded texts; all texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.workspace import materialize

LEVELS = 5
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_ITEM = re.compile(r"\s*(?:[-*+•◦▪‣☐☑✓–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s")
_LEADERS = ("....", "____", "------", "~~~~", "######", "====")
_GAP = re.compile(r"(?<=\S)(?: {3,}|\u3000)(?=\S)")
_DIGIT = re.compile(r"\d")
_QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


@dataclass(frozen=True)
class Prose:
    """The running prose of a text: its words, and its share of all characters that aren't blank."""

    words: list[str]
    share: float
    function_share: float


def prose_of(text: str | None, known: dict[str, float], function_words: frozenset[str]) -> Prose:
    """The words of lines that are prose in the language of ``known`` words.

    List items, columns, leaders, rows of numbers and lines of unknown words are not. Lines of fewer
    than four words are taken as the line before.
    """
    words: list[str] = []
    inside = total = functions = 0
    running = False
    is_known, is_plain = known.__contains__, function_words.__contains__
    for line in (text or "").splitlines():
        tokens = line.split()
        if not tokens:
            continue
        size = sum(map(len, tokens))
        total += size
        here = _WORD.findall(line.lower())
        columns = line.count("|") + line.count("\t") + line.count(";")
        if "   " in line or "\u3000" in line:
            columns += len(_GAP.findall(line))
        many = len(tokens)
        numbers = sum(1 for t in tokens if _DIGIT.search(t)) if _DIGIT.search(line) else 0
        if numbers > 0.4 * many or (columns >= 2 and columns > 0.12 * many) or any(x in line for x in _LEADERS) or _ITEM.match(line):
            running = False
        elif len(here) >= 4:
            plain = sum(map(is_plain, here))
            strange = len(here) - sum(map(is_known, here))
            if strange:
                strange -= sum(1 for w in here if is_plain(w) and not is_known(w))
            running = strange <= 0.5 * len(here) and numbers <= 0.3 * many and (plain > 0 or len(here) < 12)
        if running:
            inside += size
            words += here
            functions += sum(map(is_plain, here))
    return Prose(words, inside / total if total else 0.0, functions / len(words) if words else 0.0)


@dataclass
class Model:
    grades: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)

    def quantiles(self, words: list[str]) -> np.ndarray | None:
        known = [g for g in map(self.grades.get, words) if g is not None]
        if len(known) < 5:
            return None
        ordered = np.sort(np.array(known))
        at = np.array(_QUANTILES) * (len(known) - 1)
        low = at.astype(int)
        part = ordered[low] + (ordered[np.minimum(low + 1, len(known) - 1)] - ordered[low]) * (at - low)
        return np.r_[1.0, part, ordered.mean()]

    def level(self, words: list[str]) -> float | None:
        """From 1 to ``LEVELS``; None where fewer than five words are known, or there is no model."""
        of = self.quantiles(words) if self.weights else None
        return None if of is None else float(np.clip(of @ np.array(self.weights), 1, LEVELS))


def acquisition_grades(counts: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, float]:
    """Each word's grade, from how many graded texts of each level have it, of ``sizes`` texts."""
    out = {}
    for w, n in counts.items():
        share = (n + 0.1) / (sizes + 1)
        share /= share.sum()
        upto = np.cumsum(share)
        k = int(np.searchsorted(upto, 0.5))
        out[w] = float(k + (0.5 - (upto[k] - share[k])) / share[k] + 0.5)
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(w, grade) for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist()) for w in set(_WORD.findall(text.lower()))]
        words, grades = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(grades, pa.int32())], names=["word", "grade"])


def graded_texts(texts: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """``(id, text, level, grade)`` of at most ``most_labels`` of ``texts(id, text)`` that have
    ``labels(id, level)``, chosen by a hash of their id; several levels of a text are averaged. Null levels,
    levels outside 1 to 5 and null texts are left out."""
    graded = labels.filter(f"level between 1 and {LEVELS}").dropDuplicates().groupBy("id").agg(F.avg("level").alias("level"))
    graded = graded.orderBy(F.xxhash64("id"), "id").limit(most_labels)
    cases = texts.select("id", "text").filter("text is not null").join(F.broadcast(graded), "id").dropDuplicates(["id"])  # at most most_labels rows
    return materialize(cases.withColumn("grade", F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.bround("level").cast("int")))), "graded-texts")


def word_grades(cases: DataFrame, least: int = 5) -> dict[str, float]:
    """The grades of words of at least ``least`` of ``cases(text, grade)``."""
    sizes, counts = np.zeros(LEVELS), {}
    for r in cases.groupBy("grade").count().collect():
        sizes[r["grade"] - 1] = r["count"]
    by = [F.count_if(F.col("grade") == k).alias(f"g{k}") for k in range(1, LEVELS + 1)]
    known = cases.select("text", "grade").mapInArrow(_words, "word string, grade int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), *by)
    for word, _, *n in map(tuple, known.filter(F.col("n") >= least).collect()):
        counts[word] = np.array(n, float)
    return acquisition_grades(counts, sizes)


def fit(texts: DataFrame, labels: DataFrame, function_words: frozenset[str], most_labels: int = 20_000, least: int = 5) -> Model:
    """The model from ``labels(id, level)`` of ``texts(id, text)``, as ``graded_texts`` takes them.

    Words of fewer than ``least`` graded texts have no grade. Without graded texts nothing has a level.
    Texts stay on executors: what comes to the driver is a row of counts for each graded word, and of
    quantiles for each text.
    """
    cases = graded_texts(texts, labels, most_labels)
    model = Model(word_grades(cases, least))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                prose = prose_of(text, model.grades, function_words)
                of = model.quantiles(prose.words)
                rows.append(of.tolist() if of is not None and prose.share >= 0.5 else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("level"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "level", "quantiles"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = cases.select("id", "level", "text").mapInArrow(describe, f"id {kind}, level double, quantiles array<double>").filter("quantiles is not null").orderBy("id").toPandas()
    if len(rows) > len(_QUANTILES):
        x, y = np.array(rows["quantiles"].tolist()), rows["level"].to_numpy()
        centre = x.mean(axis=0)
        centre[0] = 0
        scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        z = (x - centre) / scale
        b = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ y) / scale
        b[0] -= centre @ b
        model.weights = b.tolist()
    return model


def levels(texts: DataFrame, model: Model, function_words: frozenset[str], least_words: int = 60, least_share: float = 0.5, least_function_share: float = 0.17) -> DataFrame:
    """``texts(id, text)`` to ``(id, prose_words, prose_share, is_prose, score, level)``, a row for each.

    ``score`` is the level with its fraction, null where nothing tells it. ``is_prose``: the text is
    mainly running prose of at least ``least_words`` words in the language of ``function_words``.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares, plain, scores = [], [], [], []
            for t in batch.column("text").to_pylist():
                prose = prose_of(t, model.grades, function_words)
                counts.append(len(prose.words))
                shares.append(prose.share)
                plain.append(len(prose.words) >= least_words and prose.share >= least_share and prose.function_share >= least_function_share)
                scores.append(model.level(prose.words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int32()), pa.array(shares, pa.float64()), pa.array(plain, pa.bool_()), pa.array(scores, pa.float64())],
                names=["id", "prose_words", "prose_share", "is_prose", "score"],
            )

    out = texts.select("id", "text").mapInArrow(run, f"id {kind}, prose_words int, prose_share double, is_prose boolean, score double")
    return out.withColumn("level", F.round("score").cast("int"))


def function_words(word_list: DataFrame, most: int = 60) -> frozenset[str]:
    """The ``most`` most frequent words of ``word_list(word, word_rank)``."""
    return frozenset(r["word"] for r in word_list.filter("word is not null").orderBy("word_rank", "word").limit(most).collect())
