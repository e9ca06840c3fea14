"""Near-duplicate texts through a byte-position inverted index with count filtering.

Every text becomes the set of its word shingles, and every set a signature of bytes. The index maps
positional bytes of the signatures to the sets having them, the entries that two sets share are
tallied, pairs of compatible sizes that reach the minimum are retained, and what is retained is
verified: the exact similarity of the two shingle sets. There are two kinds of signature.

* ``exact``: the leading bytes of the shingles' own hashes, in the order of the hashes, as many as a
  near partner can't miss: of a set of *n*, the first *n* - ceil(t n) + m. Any two sets of a similarity of
  at least *t* then share *m* entries, guaranteed; nothing is lost. Lists are as long as shingles
  are common, so this is for collections of texts without much in common, and to measure the other.
* by default: a fixed number of positions of four bytes, where the bytes at position *i* are a hash of
  the minima of the set under ``width`` permutations of that position's own. Two sets of Jaccard
  similarity *j* agree in a share *j* ^ ``width`` of the positions. One permutation a position would make
  lists of everything that is a little alike, and tallying them quadratic; so ``width`` follows from the
  threshold. There are so many positions that a pair at the threshold reaches the minimum but for a
  chance of ``miss``, and a pair above it more surely.

Texts with equal sets are one set in all of this, so copies are never paired with each other. Entries of
more than ``long_list`` sets are found by partial counts and kept out of the lists. Their sets are
dealt to parts, and each two parts of an entry meet in a task of their own, which tallies whole
signatures; so no task holds more than two parts, whatever a list's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.workspace import materialize

_WORD = re.compile(r"[^\W_]+")
_MAX_CACHED_WORDS = 500_000
#: Index entries that a retained pair shares.
MATCHES = 2
#: Bytes kept of a shingle's hash for verification; two sets of 1000 then err by one in 10^8 pairs.
_KEPT = 6


@dataclass(frozen=True)
class Similarity:
    """What counts as near: shingles of ``words`` words, sets of at least ``least`` members."""

    words: int = 5
    threshold: float = 0.8
    least: int = 1
    miss: float = 5e-4
    long_list: int = 1000
    seed: int = 20_011
    exact: bool = False

    @property
    def width(self) -> int:
        """Permutations of a position."""
        return max(1, min(6, round(math.log(0.125) / math.log(self.threshold))))

    @property
    def entries(self) -> int:
        """Entries of a set, where they are of a fixed number."""
        p = min(self.threshold**self.width, 0.999)
        n = MATCHES
        while sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(MATCHES)) > self.miss:
            n += 1
        return n

    @property
    def bytes(self) -> int:
        """Bytes of an entry in a signature."""
        return _KEPT if self.exact else 4

    @property
    def matches(self) -> int:
        """Entries that a retained pair shares at least."""
        return min(MATCHES, max(1, math.ceil(self.least * self.threshold - 1e-9))) if self.exact else MATCHES

    def prefix(self, n: int) -> int:
        """Of a set of ``n`` in order, the members that hold ``matches`` of those shared with any near set."""
        return min(n, n - math.ceil(n * self.threshold - 1e-9) + self.matches)


class _Shingler:
    """Word shingles of a text as a sorted array of distinct 64-bit hashes."""

    def __init__(self, words: int):
        rng = np.random.default_rng(7)
        self.words = words
        self.factors = rng.integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        many = len(words) - self.words + 1
        if many < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _MAX_CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
        mixed = np.zeros(many, np.uint64)
        for k, factor in enumerate(self.factors):
            mixed += ids[k : k + many] * factor
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


class _Signer:
    """Signatures of shingle sets."""

    def __init__(self, how: Similarity):
        self.how = how
        rng = np.random.default_rng(how.seed)
        many = 0 if how.exact else how.entries * how.width
        self.a = (rng.integers(1, 2**32, many, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, many, dtype=np.uint32)[:, None]
        self.factors = rng.integers(1, 2**63, how.width, dtype=np.uint64) | np.uint64(1)
        self.buffer = np.empty(many * 512, np.uint32)

    def __call__(self, members: np.ndarray) -> bytes:
        how = self.how
        if how.exact:
            return _cut(members[: how.prefix(len(members))])
        small = (members >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(small), 512):  # bounded memory for very long texts
            some = small[at : at + 512]
            hashed = self.buffer[: len(self.a) * len(some)].reshape(len(self.a), len(some))
            np.multiply(self.a, some[None, :], out=hashed)
            hashed += self.b
            np.minimum(least, hashed.min(axis=1), out=least)
        mixed = (least.reshape(how.entries, how.width).astype(np.uint64) * self.factors).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype("<u4").tobytes()


def _codes(signature: bytes, how: Similarity) -> np.ndarray:
    """The entries of a signature as numbers; without ``exact`` their position is part of them."""
    if how.exact:
        return _whole(signature).astype(np.int64)
    return np.frombuffer(signature, "<u4").astype(np.int64) + (np.arange(len(signature) // 4, dtype=np.int64) << 32)


def sketches(texts: DataFrame, how: Similarity) -> DataFrame:
    """``texts(id, owner, text)`` to one row per distinct id with at least ``how.least`` shingles:
    ``(id, owner, digest, size, signature)``; ``digest`` names the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _Shingler(how.words)
        sign = _Signer(how)
        for batch in batches:
            ids, owners, digests, sizes, signatures = [], [], [], [], []
            for i, o, t in zip(*(batch.column(c).to_pylist() for c in ("id", "owner", "text"))):
                members = shingle(t)
                if len(members) >= max(1, how.least):
                    ids.append(i)
                    owners.append(o)
                    digests.append(xxhash.xxh3_128_digest(members.tobytes()))
                    sizes.append(len(members))
                    signatures.append(sign(members))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(owners, pa.string()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())],
                names=["id", "owner", "digest", "size", "signature"],
            )

    return texts.mapInArrow(run, "id string, owner string, digest binary, size int, signature binary")


_SIZE = 1 << 16


@dataclass(frozen=True)
class _Heavy:
    """Slots of entries that may be hot: a table of them, and a bit for each in a filter of fixed size."""

    slots: int
    table: DataFrame | None
    bits: bytes

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # tables stay with the driver

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Whether entries may be in heavy slots."""
        at = _slot(codes, self.slots) % (8 * len(self.bits))
        return np.frombuffer(self.bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


_FILTER = 1 << 20


def _index(reps: DataFrame, how: Similarity, heavy: _Heavy | None = None) -> DataFrame:
    """``reps(key, size, signature)`` to ``(set, entry)``, one row per set and index entry, or of entries
    that may be in ``heavy`` slots only.

    What is shuffled most has few bytes: ``set`` holds the key with the size (at most 65535) behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("key").to_numpy() * _SIZE + np.minimum(batch.column("size").to_numpy(), _SIZE - 1)
            codes = [_codes(s, how) for s in batch.column("signature").to_pylist()]
            if codes:
                named, entries = np.repeat(sets, [len(c) for c in codes]), np.concatenate(codes)
                if heavy is not None:
                    there = heavy.of(entries)
                    named, entries = named[there], entries[there]
                yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(entries)], names=["set", "entry"])

    return reps.select("key", "size", "signature").mapInArrow(run, "set bigint, entry bigint")


def _slots(reps: DataFrame, how: Similarity, slots: int) -> DataFrame:
    """``(slot, n)``: entries by slots, counted within each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_codes(s, how) for s in batch.column("signature").to_pylist()]
            if codes:
                slot, n = np.unique(_slot(np.concatenate(codes), slots), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return reps.select("signature").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def _slot(codes: np.ndarray, slots: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)


def _close(p: Column, q: Column, how: Similarity) -> Column:
    return F.least(p, q) >= how.threshold * F.greatest(p, q)


def _hot(reps: DataFrame, how: Similarity, rows: int) -> tuple[DataFrame, _Heavy] | None:
    """``(entry, n)`` of more than ``long_list`` sets, and their slots; None if there is none. Entries are
    counted by slots first, by partial sums, and one by one only in slots that exceed the length."""
    slots = max(1024, 8 * rows // how.long_list)
    table = materialize(_slots(reps, how, slots).filter(F.col("n") > how.long_list).select("slot"), "near-slots")
    at = table.select(F.pmod("slot", F.lit(8 * _FILTER)).alias("at")).distinct().toArrow().column("at").to_numpy()  # as many as the filter has bits at most
    if not len(at):
        return None
    bits = np.zeros(8 * _FILTER, np.uint8)
    bits[at] = 1
    heavy = _Heavy(slots, table, np.packbits(bits, bitorder="little").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("entry").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(_slot(codes, slots))], names=["entry", "slot"])

    placed = _index(reps, how, heavy).select("entry").mapInArrow(run, "entry bigint, slot bigint")
    counted = placed.join(table, "slot").groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counted.filter(F.col("n") > how.long_list), "near-hot")
    return None if hot.isEmpty() else (hot, heavy)


def _meetings(reps: DataFrame, hot: DataFrame, heavy: _Heavy, how: Similarity) -> DataFrame:
    """``(a, b)``, the pairs retained among the sets of hot entries. A pair comes from the first hot entry
    that it shares."""
    own = reps.select("key", "size", "signature")
    listed = _index(reps, how, heavy).select(F.shiftright("set", 16).alias("key"), "entry").join(hot, "entry")
    marks = materialize(listed.select("key", "entry", F.ceil(F.col("n") / how.long_list).cast("int").alias("parts")), "near-marks")
    hots = marks.groupBy("key").agg(F.collect_list("entry").alias("hot"))  # at most as many as a set has entries
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = marks.withColumn("part", part).withColumn("other", other).select("key", "entry", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    full = cells.join(own.join(hots, "key"), "key")

    def meet(rows: pa.Table) -> pa.Table:
        entry, i, j = (rows.column(c)[0].as_py() for c in ("entry", "i", "j"))
        keys, sizes, parts = (rows.column(c).to_numpy() for c in ("key", "size", "part"))
        entries, hots = [_codes(s, how) for s in rows.column("signature").to_pylist()], rows.column("hot").to_pylist()
        left, right = np.flatnonzero(parts == i), np.flatnonzero(parts == j)

        def tally(of: list[list[int]]) -> np.ndarray:
            def flat(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                lists = [np.unique(np.array(of[k], np.int64)) for k in side]
                return np.concatenate([*lists, np.empty(0, np.int64)]), np.repeat(np.arange(len(side)), [len(x) for x in lists])

            (x, at_x), (y, at_y) = flat(left), flat(right)
            both = np.intersect1d(x, y)
            out = np.zeros((len(left), len(right)), np.float32)
            for k in range(0, len(both), 2048):
                some = both[k : k + 2048]
                sides = []
                for codes, at, many in ((x, at_x, len(left)), (y, at_y, len(right))):
                    place = np.minimum(np.searchsorted(some, codes), len(some) - 1)
                    there = some[place] == codes
                    side = np.zeros((many, len(some)), np.float32)
                    side[at[there], place[there]] = 1
                    sides.append(side)
                out += sides[0] @ sides[1].T
            return out

        kept = tally([[e for e in h if e < entry] for h in hots]) == 0
        p, q = sizes[left][:, None], sizes[right][None, :]
        kept &= np.minimum(p, q) >= how.threshold * np.maximum(p, q)
        if kept.any():  # in a family of much the same sets nearly all pairs come from one entry
            kept &= tally(entries) >= how.matches
        a, b = np.nonzero(kept)
        a, b = keys[left[a]], keys[right[b]]
        different = a < b if i == j else a != b
        a, b = a[different], b[different]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return full.groupBy("entry", "i", "j").applyInArrow(meet, "a bigint, b bigint")


def candidates(reps: DataFrame, how: Similarity, many: int) -> DataFrame:
    """Pairs ``(a, b)`` of keys, ``a < b``, that share at least ``how.matches`` index entries.

    Keys are numbers below ``many``. Up to 2^31 of them a pair is tallied under a single number.
    """
    index = _index(reps, how)
    rows = reps.agg(F.sum(F.floor(F.length("signature") / how.bytes))).first()[0] or 0
    hot = _hot(reps, how, rows)
    short = index if hot is None else index.join(hot[0].select("entry"), "entry", "left_anti")
    lists = Window.partitionBy("entry")  # of at most long_list rows
    counted = short.withColumn("many", F.count(F.lit(1)).over(lists)).filter("many > 1")
    met = materialize(counted.groupBy("entry").agg(F.sort_array(F.collect_list("set")).alias("sets")), "near-index")
    key = lambda c: F.shiftright(c, 16)
    pair = [key("x") * (1 << 31) + key("y")] if many <= 1 << 31 else [key("x"), key("y")]
    pair = [c.alias(f"p{k}") for k, c in enumerate(pair)]
    names = [f"p{k}" for k in range(len(pair))]
    beside = (
        met.select("sets", F.posexplode("sets").alias("at", "x"))
        .select("x", F.explode(F.slice("sets", F.col("at") + 2, F.greatest(F.size("sets") - F.col("at") - 1, F.lit(0)))).alias("y"))
        .filter(_close(F.pmod("x", F.lit(_SIZE)), F.pmod("y", F.lit(_SIZE)), how) & (key("x") != key("y")))
        .select(*pair)
    )
    found = beside.repartition(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= how.matches).select(*names)
    if len(names) == 1:
        found = found.select(F.shiftright("p0", 31).alias("a"), F.col("p0").bitwiseAND((1 << 31) - 1).alias("b"))
    else:
        found = found.select(F.col("p0").alias("a"), F.col("p1").alias("b"))
    return found if hot is None else found.unionByName(_meetings(reps, *hot, how)).distinct()


def _jaccard():
    @F.pandas_udf("double")
    def jaccard(x, y):  # type: ignore[no-untyped-def]
        import pandas as pd

        out = []
        for p, q in zip(x, y):
            p, q = (_whole(side) for side in (p, q))
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common / max(1, len(p) + len(q) - common))
        return pd.Series(out, dtype="float64")

    return jaccard


def _cut(members: np.ndarray) -> bytes:
    return members.view(np.uint8).reshape(-1, 8)[:, :_KEPT].tobytes()


def _whole(kept: bytes) -> np.ndarray:
    out = np.zeros((len(kept) // _KEPT, 8), np.uint8)
    out[:, :_KEPT] = np.frombuffer(kept, np.uint8).reshape(-1, _KEPT)
    return out.view(np.uint64).ravel()


def _members(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _Shingler(words)
        for batch in batches:
            sets = [_cut(shingle(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, shingles binary")


@dataclass(frozen=True)
class Near:
    """``links(a, b, similarity)`` between sets by ``key``; ``rows(id, owner, key)``."""

    links: DataFrame
    rows: DataFrame


def _numbered(reps: DataFrame) -> tuple[DataFrame, int]:
    """``reps`` with ``key`` (a partition and a row in it) made a number from 0 without gaps, and how
    many there are. To the driver comes one number a partition."""
    part = F.shiftright("key", 33)
    counts = reps.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, many = [], 0
    for r in counts:
        offsets.append((r["part"], many))
        many += r["n"]
    before = F.broadcast(reps.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    key = F.col("key").bitwiseAND((1 << 33) - 1) + F.col("offset")
    return reps.withColumn("part", part).join(before, "part").withColumn("key", key).drop("part", "offset"), many


def near(texts: DataFrame, how: Similarity) -> Near:
    """The near pairs among ``texts(id, owner, text)``.

    Repeated rows count once. Texts that are null, empty or of fewer than ``how.least`` shingles
    have no row and no link. Equal shingle sets share one ``key``; ``links`` holds each pair of
    different sets of a similarity of at least ``how.threshold`` once.
    """
    sketch = materialize(sketches(texts, how), "near-sketch")
    reps = materialize(
        sketch.groupBy("digest").agg(F.min_by(F.struct("id", "size", "signature"), "id").alias("r")).select("digest", "r.*").withColumn("key", F.monotonically_increasing_id()),
        "near-sets",
    )
    reps, many = _numbered(reps)
    rows = materialize(sketch.select("id", "owner", "digest").dropDuplicates(["id"]).join(reps.select("digest", "key"), "digest").drop("digest"), "near-rows")
    side = lambda s: reps.select(F.col("key").alias(s), F.col("id").alias(f"id_{s}"))
    kept = materialize(candidates(reps, how, many).join(side("a"), "a").join(side("b"), "b"), "near-kept")
    wanted = kept.select(F.col("a").alias("key"), F.col("id_a").alias("id")).unionByName(kept.select(F.col("b").alias("key"), F.col("id_b").alias("id"))).distinct()
    sets = materialize(_members(texts.select("id", "text").join(wanted, "id").dropDuplicates(["id"]), how.words), "near-shingles")
    links = (
        kept.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", _jaccard()("x", "y").alias("similarity"))
        .filter(F.col("similarity") >= how.threshold - 1e-12)
    )
    return Near(links, rows)


def pairs(found: Near) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: the near pairs of ids whose owners differ, copies included.

    This lists every pair of copies too, as many as there are; ``groups`` is the form for collections
    where one text has very many of them.

    A null owner differs from none, so its rows give no pair.
    """
    left = found.rows.select(F.col("key").alias("a"), F.col("id").alias("x"), F.col("owner").alias("p"))
    right = found.rows.select(F.col("key").alias("b"), F.col("id").alias("y"), F.col("owner").alias("q"))
    between = found.links.join(left, "a").join(right, "b").select("x", "p", "y", "q")
    within = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "p", "y", "q")
    return (
        between.unionByName(within)
        .filter("p != q")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def groups(found: Near) -> DataFrame:
    """One row per id: ``(id, class_id, links)``; ``class_id`` is the least id of those reachable
    through near links, ``links`` the number of other texts (distinct shingle sets) linked to it.

    Components by alternating large-star and small-star steps on links between distinct sets until
    nothing changes, each step written to the shared folder; no group is gathered in one place.
    """
    named = found.rows.groupBy("key").agg(F.min("id").alias("name"))
    edges = materialize(found.links.select("a", "b"), "near-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("links"))
    current, before = edges, None
    while True:  # the steps end: each lowers a node's neighbour or changes nothing
        two = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = two.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.select(F.col("b").alias("n"), F.col("a").alias("m"))
        least = down.groupBy("n").agg(F.min("m").alias("l"))
        small = down.join(least, "n").select(F.col("l").alias("a"), F.explode(F.array("n", "m")).alias("b")).filter("a < b").distinct()
        current = materialize(small, "near-star")
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    root = current.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("root"))
    labelled = named.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = labelled.groupBy("root").agg(F.min("name").alias("class_id"))
    of = labelled.join(classes, "root").select("key", "class_id").join(degree, "key", "left")
    return found.rows.select("id", "key").join(of, "key").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
