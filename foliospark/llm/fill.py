"""Filling containers of fixed capacity by best-two-fit.

A container is filled greedily with the largest item that fits until none does. Then its smallest
item is taken out if two unpacked items fill the larger gap more tightly than it did, and so on
while that helps. Items are told apart by size only while packing, so a step costs the same however
many items there are.

Items are packed in shards of about ``shard_tokens`` tokens, by a hash of their key; a shard wastes
at most the space of its last containers, a share of about ``2 * capacity / shard_tokens``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.workspace import materialize


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each item; sizes are from 1 to ``capacity``."""
    left = np.bincount(sizes, minlength=capacity + 1)
    axis = np.arange(capacity + 1)
    #: largest size that is left and at most x, 0 if none
    below = np.maximum.accumulate(np.where(left > 0, axis, 0))

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            below[size : np.searchsorted(below, size, "right")] = below[size - 1]

    def give(size: int) -> None:
        left[size] += 1
        below[size : max(size, np.searchsorted(below, size, "left"))] = size

    bins: list[list[int]] = []
    while below[capacity]:
        held, gap = [], capacity
        while gap and (size := int(below[gap])):
            take(size)
            held.append(size)
            gap -= size
        while gap:
            smallest = min(held)
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1])
            if not len(first):
                break
            second = below[room - first]
            alone = (second == first) & (left[first] < 2)  # the same item can't be taken twice
            if alone.any():
                second = np.where(alone, below[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            k = int(both.argmax())
            if both[k] <= smallest:
                break
            a, b = int(first[k]), int(second[k])
            held.remove(smallest)
            take(a)
            take(b)
            give(smallest)
            held += [a, b]
            gap = room - a - b
        bins.append(held)
    where = np.fromiter((k for k, held in enumerate(bins) for _ in held), np.int64)
    by_size = np.argsort(np.fromiter((s for held in bins for s in held), np.int64), kind="stable")
    out = np.empty(len(sizes), np.int64)
    out[np.argsort(sizes, kind="stable")] = where[by_size]
    return out


def fill(items: DataFrame, capacity: int, shard_tokens: int = 4_000_000) -> DataFrame:
    """``items(key bigint, tokens int)`` to one row per item or piece:
    ``(key, piece_no, start_token, tokens, container_id, position)``.

    An item above the capacity is cut into full pieces and a rest; no other item is cut. Items
    without tokens (or with a null size) are kept with a null container. Rows that repeat a key are
    items of their own. ``container_id`` is a string of the shard and the container in it.
    """
    sized = materialize(items.select("key", F.coalesce("tokens", F.lit(0)).alias("n")), "fill-items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(total / max(shard_tokens, capacity)))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")))
    pieces = sized.select("key", "n", at.alias("piece_no")).select(
        "key", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("tokens"),
    )
    shard = F.pmod(F.xxhash64("key", "piece_no"), F.lit(shards)).cast("int")
    full = F.col("tokens") == capacity
    whole = pieces.filter(full | (F.col("tokens") <= 0)).select(
        "*", F.when(full, F.concat_ws("-", F.lit("full"), "key", "piece_no")).alias("container_id"), F.when(full, 0).cast("int").alias("position")
    )

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by([("tokens", "descending"), ("key", "ascending"), ("piece_no", "ascending")])
        bins = best_two_fit(part.column("tokens").to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1]
        position = np.empty(len(bins), np.int32)
        position[order] = np.arange(len(bins)) - np.repeat(starts, np.diff(np.r_[starts, len(bins)]))
        name = part.column("shard")[0].as_py()
        part = part.select(["key", "piece_no", "start_token", "tokens"])
        return part.append_column("container_id", pa.array([f"{name}-{b}" for b in bins])).append_column("position", pa.array(position))

    schema = "key bigint, piece_no int, start_token bigint, tokens int, container_id string, position int"
    packed = pieces.filter(~full & (F.col("tokens") > 0)).withColumn("shard", shard).groupBy("shard").applyInArrow(pack, schema)
    return packed.unionByName(whole)
