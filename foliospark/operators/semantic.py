"""Splitting by meaning: sentences, vectors of sentence windows, and breaks where they drift apart."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.config import Settings, provider_kind
from foliospark.functions import folds
from foliospark.operators import prose, providers
from foliospark.workspace import materialize, shared_dir

Embedder = Callable[[Column], Column]


def hashed(text: Column) -> Column:
    """A stand-in for a model: the first 16 bytes of the text's SHA-256, each over 255, natively."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


hashed.native = True  # type: ignore[attr-defined]


def hashed_vector(text: str) -> list[float]:
    return [b / 255 for b in hashlib.sha256(text.encode()).digest()[:16]]


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def distances(vectors: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """``(keys…, order, distance)``: from each vector to the next in order; the last has null."""
    follow = Window.partitionBy(*keys).orderBy(order)
    return vectors.withColumn("_next", F.lead(vector).over(follow)).select(*keys, order, F.when(F.col("_next").isNotNull(), cosine_distance(F.col(vector), F.col("_next"))).alias("distance"))


def threshold(of: DataFrame, keys: list[str], kind: str = "percentile", amount: float = 95.0) -> DataFrame:
    """``(keys…, threshold)`` over ``distance``: a percentile, mean and deviations, mean and quartile
    ranges, or a percentile of the gradient (the last needs the order in ``of``'s second key)."""
    d = F.col("distance")
    if kind == "percentile":
        at = F.percentile(d, F.lit(amount / 100))
    elif kind == "standard_deviation":
        at = F.avg(d) + F.lit(amount) * F.stddev_pop(d)
    elif kind == "interquartile":
        at = F.avg(d) + F.lit(amount) * (F.percentile(d, F.lit(0.75)) - F.percentile(d, F.lit(0.25)))
    elif kind == "gradient":
        return threshold(of.withColumn("distance", F.col("gradient")), keys, "percentile", amount)
    else:
        raise ValueError(f"unknown kind of threshold: {kind}")
    return of.groupBy(*keys).agg(at.alias("threshold"))


def with_gradient(of: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The slope of ``distance``: half the difference of both neighbours, or to the only one."""
    w = Window.partitionBy(*keys).orderBy(order)
    left, right = F.lag("distance").over(w), F.lead("distance").over(w)
    slope = F.when(left.isNotNull() & right.isNotNull(), (right - left) / 2).when(right.isNotNull(), right - F.col("distance")).otherwise(F.col("distance") - left)
    return of.withColumn("gradient", slope)


def breaks(of: DataFrame, keys: list[str], order: str, kind: str = "percentile", amount: float = 95.0) -> DataFrame:
    """``of(keys…, order, distance)`` with ``cut`` (a break behind this one) and ``piece``."""
    if kind == "gradient":
        of = with_gradient(of, keys, order)
    measured = F.col("gradient") if kind == "gradient" else F.col("distance")
    with_t = of.join(threshold(of, keys, kind, amount), keys)
    cut = F.coalesce(measured > F.col("threshold"), F.lit(False))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return with_t.withColumn("cut", cut).withColumn("piece", F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0)))


def array_breaks(d: Column, kind: str = "percentile", amount: float = 95.0) -> Column:
    """``breaks`` within one row: where pieces begin, counted from 1, by the distances ``d`` from each
    sentence to the next."""
    many = F.size(d)
    measured = d
    if kind == "gradient":
        at = lambda i: F.get(d, i)
        measured = F.transform(d, lambda x, i: F.when((i > 0) & (i < many - 1), (at(i + 1) - at(i - 1)) / 2).when(i < many - 1, at(i + 1) - x).otherwise(x - at(i - 1)))

    def percentile(p: float) -> Column:
        ordered, at = F.array_sort(measured), (many - 1) * p
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.when(low == high, F.get(ordered, low)).otherwise((high - at) * F.get(ordered, low) + (at - low) * F.get(ordered, high))

    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total(measured) / many
    if kind in ("percentile", "gradient"):
        limit = percentile(amount / 100)
    elif kind == "standard_deviation":
        limit = mean + amount * F.sqrt(total(F.transform(measured, lambda v: (v - mean) * (v - mean))) / many)
    elif kind == "interquartile":
        limit = mean + amount * (percentile(0.75) - percentile(0.25))
    else:
        raise ValueError(f"unknown kind of threshold: {kind}")
    cuts = F.filter(F.transform(measured, lambda v, i: F.when(v > limit, i + 2)), lambda i: i.isNotNull())
    return F.when(many > 0, F.concat(F.array(F.lit(1)), cuts)).otherwise(F.array(F.lit(1)))


def splitter(embed: Embedder, window: int = 1, cache: str | None = None) -> prose.Splitter:
    """A splitter for prose: each sentence is embedded together with its neighbours. Vectors are taken
    from the table at ``cache`` where it has them, and new ones appended to it.

    A parent's sentences are an array throughout; only models that aren't native see them as rows.
    """

    def split(parents: DataFrame, cfg: Settings) -> DataFrame:
        said = parents.select("parent_id", prose.sentences(F.col("text")).alias("sentences")).filter(F.size("sentences") > 0)
        low = lambda i: F.greatest(i - window, F.lit(0))
        near = F.transform("sentences", lambda x, i: F.array_join(F.slice("sentences", low(i) + 1, i - low(i) + window + 1), " "))
        if getattr(embed, "native", False) and cache is None:
            whole = said.withColumn("vectors", F.transform(near, embed))
        else:
            each = said.select("parent_id", F.posexplode(F.arrays_zip(F.col("sentences").alias("sentence"), near.alias("near"))).alias("at", "x")).select("parent_id", "at", "x.sentence", "x.near")
            rows = each.withColumn("vector", embed(F.col("near"))) if cache is None else _from_cache(each, cache, embed)
            whole = rows.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("at", "sentence", "vector"))).alias("v"))
            whole = whole.select("parent_id", F.transform("v", lambda x: x["sentence"]).alias("sentences"), F.transform("v", lambda x: x["vector"]).alias("vectors"))
        rest = F.size("vectors") - 1
        apart = whole.withColumn("d", F.zip_with(F.slice("vectors", 1, rest), F.slice("vectors", 2, rest), cosine_distance))
        starts = apart.withColumn("starts", array_breaks(F.col("d"), cfg.breakpoint_threshold_type, cfg.breakpoint_threshold_amount))
        pieces = F.transform(folds.cut(F.col("sentences"), F.col("starts")), lambda x: F.array_join(x, " "))
        return starts.select("parent_id", F.posexplode(pieces).alias("at", "text"))

    return split


def _from_cache(windows: DataFrame, path: str, embed: Embedder) -> DataFrame:
    spark = windows.sparkSession
    windows = materialize(windows.withColumn("hash", F.sha2("near", 256)), "sentence-windows")
    kept = read_cache(spark, path)
    hits = kept.dropDuplicates(["hash"]).join(windows.select("hash").distinct(), "hash", "left_semi")
    # written before either is read, so nothing is embedded twice
    fresh = materialize(cached(windows.select(F.col("near").alias("text")), kept, embed)[1], "fresh-vectors")
    vectors = materialize(hits.unionByName(fresh), "vectors")
    fresh.write.mode("append").parquet(path)
    return windows.join(vectors, "hash").drop("hash", "near")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The vectors kept at ``path``, ``(hash, vector)``; none if nothing is there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    schema = "hash string, vector array<double>"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def cache_path(spark: SparkSession, cfg: Settings) -> str | None:
    """Where vectors of the configured model are kept: by itself if ``cache_dir`` is an address or an
    absolute path, else in the shared folder."""
    if not cfg.enable_embedding_cache:
        return None
    model = {"hosted": cfg.embedding_deployment, "local": cfg.local_embedding_model}.get(provider_kind(cfg.embedding_provider), cfg.embedding_provider)
    own = "://" in cfg.cache_dir or cfg.cache_dir.startswith("/")
    return f"{cfg.cache_dir if own else shared_dir(spark) + '/' + cfg.cache_dir}/{re.sub(r'[^A-Za-z0-9.-]+', '_', model)}"


def cached(texts: DataFrame, cache: DataFrame, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``texts(text)`` by way of ``cache(hash, vector)``: ``(hash, text, vector)`` for each
    different text, and the rows to append to the cache. A text is embedded once, if the second is
    written before the first is read."""
    wanted = texts.filter("text is not null").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    known = cache.dropDuplicates(["hash"])
    missing = wanted.join(known, "hash", "left_anti").withColumn("vector", embed(F.col("text")))
    hits = wanted.join(known, "hash")
    return hits.unionByName(missing), missing.select("hash", "vector")


EMBEDDERS: dict[str, Callable[[Settings], Embedder]] = {"hashed": lambda cfg: hashed}


def embedder(cfg: Settings, given: Embedder | None = None) -> Embedder:
    """The embedder of ``cfg.embedding_provider``; ``given`` comes first, then those registered in
    ``EMBEDDERS``, then the models of ``providers``."""
    if given is not None:
        return given
    if cfg.embedding_provider not in EMBEDDERS:
        return model_embedder(providers.vectors(cfg), cfg.embedding_batch_size)
    return EMBEDDERS[cfg.embedding_provider](cfg)


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> Embedder:
    """An embedder of a Python model, loaded once in each worker and given ``batch`` texts at a time;
    vectors are scaled to length 1."""

    def embed(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batches):  # type: ignore[no-untyped-def]
            import numpy as np
            import pandas as pd

            model = load()
            for series in batches:
                out = []
                for k in range(0, len(series), batch):
                    v = np.asarray(model(series.iloc[k : k + batch].tolist()), float)
                    out += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
                yield pd.Series(out)

        run.__annotations__ = {}
        return run(text)

    return embed
