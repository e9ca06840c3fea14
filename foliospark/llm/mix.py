"""Mixing overlapping sources to target shares by minimum-cost flow.

Records are put together by the set of sources they belong to (their pattern). A flow network routes
tokens from patterns to sources: using a pattern's tokens for the k-th time costs k - 1, so first
uses come before repeats everywhere; a source takes its quota at most, and from a pattern at most
``max_repeats`` times its tokens. Records are then drawn in a seeded order, as many as the flow says.

The network has a node for each pattern and source, not for records. Of patterns there may be up to
``2 ** sources``; the ``most_patterns`` largest are nodes of their own, and records of smaller ones count
for one of their sources only, drawn by the target shares. Nothing is left out by that; only the choice
of a source for those records is made before the flow.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.workspace import materialize

Pattern = tuple[str, ...]


def min_cost_flow(capacity: dict[Pattern, int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[Pattern, str], int]:
    """Tokens from each pattern to each source: as many as the quotas allow, with fewest repeats."""
    edges: list[list] = []  # from, to, room, cost
    out: dict[object, list[int]] = defaultdict(list)

    def edge(a: object, b: object, room: int, cost: int) -> int:
        out[a].append(len(edges))
        edges.append([a, b, room, cost])
        out[b].append(len(edges))
        edges.append([b, a, 0, -cost])
        return len(edges) - 2

    arcs = {}
    for p, size in capacity.items():
        takers = [s for s in p if quota.get(s)]
        if not size or not takers:
            continue
        for k in range(max(repeats[s] for s in takers)):
            edge("start", ("p", p), size, k)
        for s in takers:
            arcs[p, s] = edge(("p", p), ("s", s), size * repeats[s], 0)
    for s, q in quota.items():
        if q:
            edge(("s", s), "end", q, 0)
    while True:
        cost, by = {"start": 0}, {}
        queue = ["start"]
        while queue:  # Bellman-Ford by queue: residual arcs may have negative costs
            a = queue.pop(0)
            for e in out[a]:
                _, b, room, c = edges[e]
                if room > 0 and cost[a] + c < cost.get(b, math.inf):
                    cost[b], by[b] = cost[a] + c, e
                    if b not in queue:
                        queue.append(b)
        if "end" not in cost:
            break
        path, at = [], "end"
        while at != "start":
            path.append(by[at])
            at = edges[by[at]][0]
        moved = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= moved
            edges[e ^ 1][2] += moved
    return {k: edges[e + 1][2] for k, e in arcs.items() if edges[e + 1][2]}


def _narrowed(sized: DataFrame, per: DataFrame, wanted: dict[str, tuple[float, int]], most: int, seed: int) -> DataFrame:
    """``sized`` with each record of a pattern beyond the ``most`` largest made one of one of its sources,
    drawn by their target shares."""
    kept = per.orderBy(F.col("size").desc(), "pattern").limit(most).select("pattern", F.lit(True).alias("_kept"))
    shares = F.create_map(*[F.lit(x) for s, (share, _) in wanted.items() for x in (s, float(share))])
    total = F.aggregate("pattern", F.lit(0.0), lambda n, s: n + shares[s])
    at = F.pmod(F.xxhash64(F.lit(seed), "key", F.lit("source")), F.lit(1 << 31)) / (1 << 31) * total
    none = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("s"))
    step = lambda a, s: F.when(a["s"].isNotNull(), a).otherwise(F.struct((a["upto"] + shares[s]).alias("upto"), F.when(a["upto"] + shares[s] > at, s).alias("s")))
    one = F.array(F.coalesce(F.aggregate("pattern", none, step, lambda a: a["s"]), F.element_at("pattern", 1)))
    return sized.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.col("_kept"), F.col("pattern")).otherwise(one)).drop("_kept")


def mix(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 13, most_patterns: int = 4096, bucket_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``records(key, sources array<string>, tokens)`` and ``targets(source, target_share,
    max_repeats)`` to the mix and its report.

    The mix has ``(key, source, times, tokens)``: how often a record is used, and for which source.
    The report has, for each target, ``(source, target_share, max_repeats, available_tokens,
    quota_tokens, mixed_tokens, actual_share)``. ``total_tokens`` is the size aimed at; by default
    all tokens of records of any target source. A source that can't fill its quota gives all it
    may; what it lacks isn't given to others, so these keep their proportions. Records without
    tokens, without a source, or of no target source aren't used. Repeated targets count once; null
    shares and repeats are 0.
    """
    spark = records.sparkSession
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.dropDuplicates(["source"]).collect() if r["source"] is not None}
    names = F.array(*[F.lit(s) for s in sorted(wanted)]) if wanted else F.array().cast("array<string>")
    pattern = F.array_sort(F.array_intersect(F.coalesce("sources", F.array().cast("array<string>")), names))
    draw = F.xxhash64(F.lit(seed), "key")
    sized = materialize(
        records.select("key", pattern.alias("pattern"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("n"), draw.alias("draw"))
        .filter((F.size("pattern") > 0) & (F.col("n") > 0)),
        "mix-records",
    )
    buckets = max(1024, sized.count() // bucket_rows)
    sized = sized.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.lit(buckets)).cast("int"))
    per = materialize(sized.groupBy("pattern").agg(F.sum("n").alias("size")), "mix-patterns")
    if per.count() > most_patterns:
        sized = _narrowed(sized, per, wanted, most_patterns, seed)
    sums = sized.groupBy("pattern", "bucket").agg(F.sum("n").alias("size"))
    have = {tuple(r["pattern"]): r["size"] for r in sums.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}  # most_patterns and sources at most
    total = sum(have.values()) if total_tokens is None else total_tokens
    quota = {s: round(share * total) for s, (share, _) in wanted.items()}
    flow = min_cost_flow(have, quota, {s: r for s, (_, r) in wanted.items()})
    spans, upto = [], defaultdict(int)
    for (p, s), tokens in sorted(flow.items()):
        spans.append((list(p), s, have[p], upto[p], upto[p] + tokens))
        upto[p] += tokens
    route = spark.createDataFrame(spans, "pattern array<string>, source string, size bigint, lo bigint, hi bigint")
    # where each record starts on its pattern's line of tokens: bucket sums first, then inside a bucket
    before = sums.withColumn("offset", F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size")).drop("size")
    inside = Window.partitionBy("pattern", "bucket").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(before, ["pattern", "bucket"]).withColumn("x", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.floor(F.col("n") / 2))
    # the line is walked round and round; a source uses a record as often as its stretch passes x
    passes = lambda end: F.floor((F.col(end) - F.col("x") + F.col("size") - 1) / F.col("size"))
    used = (
        placed.join(F.broadcast(route), "pattern")  # at most patterns x sources rows
        .withColumn("times", (passes("hi") - passes("lo")).cast("int"))
        .filter("times > 0")
    )
    mixed = used.select("key", "source", "times", F.col("n").alias("tokens"))
    own = sized.select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("times") * F.col("tokens")).alias("mixed_tokens"))
    goal = spark.createDataFrame([(s, share, r, quota[s]) for s, (share, r) in wanted.items()], "source string, target_share double, max_repeats int, quota_tokens bigint")
    share = F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    report = (
        goal.join(own, "source", "left").join(got, "source", "left").fillna(0, ["available_tokens", "mixed_tokens"])
        .withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
        .select("source", "target_share", "max_repeats", "available_tokens", "quota_tokens", "mixed_tokens", "actual_share")
    )
    return mixed, report
