"""Mixing sources to target weights.

The documents of a source, in a pseudorandom order, are packed into blocks of
``BLOCK`` words (the last may be shorter).  The mix is a sequence of slots, dealt
to output shards: each shard draws how many slots each source gets, from a
multinomial over what the sources still owe, so that the shards look alike and
the totals meet the targets.  Slot j of a source is mapped through the source's
pseudorandom permutation of block indices, a new one each time all its blocks
were used, and blocks are joined by index.  The last slot of a source takes only
the words that its target still lacks.

The draws are made by halves: of the shards of a range, the first half gets a
random part of each source's slots, and so on down to single shards, each range
with a seed of its own.  So tasks draw for their own ranges, in any order.

Scale: offsets come from two-level prefix sums over hashed buckets, so a source
with a third of all rows is packed by many tasks, a bucket having about
``BUCKET_DOCS`` documents of one source whatever the source's size; the join by
(source, block) is even, as every block is a key of its own.  The driver holds
one row per source and at most ``NODE_CELLS`` counts of ranges.

Defined results: a null text has no words; a document without words is never
taken; null is a source of its own, last in order; rows that share a doc_id
are mixed as documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm import words as W
from wordloom.llm.store import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2.0
BLOCK = 256
SEED = 20240101
#: Documents a packing bucket holds on average.
BUCKET_DOCS = 10_000
SHARD_SLOTS = 4096
#: Ranges of shards that the driver draws for, and counts (ranges times sources) that it holds.
NODES = 256
NODE_CELLS = 1 << 22
#: Sources whose numbers may be broadcast.
BROADCAST_SOURCES = 200_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words to take from each source, given in order.

    The sources split ``share`` of all words by their weights, which repeat;
    none gets more than ``repeats`` times its size, and what exceeds that is
    split again among the others.
    """
    owed, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: owed * weights[i % len(weights)] / total for i in open_}
        over = {i for i in open_ if part[i] > repeats * sizes[i]}
        for i in over or open_:
            out[i] = repeats * sizes[i] if over else part[i]
        if not over:
            break
        owed -= sum(out[i] for i in over)
        open_ -= over
    return out


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    return W.mix(x ^ W.U64(key)) & W.U64((1 << half) - 1)


def _keys(seed: int) -> list[int]:
    return [int(k) for k in W.mix(np.arange(1, 5, dtype=W.U64) * W.U64(0x9E3779B97F4A7C15) + W.U64(seed & (1 << 64) - 1))]


def permuted(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network, walked until in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = W.U64((1 << half) - 1), _keys(seed)
    y, todo = x.astype(W.U64), np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = y[todo] >> W.U64(half), y[todo] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ _round(left, key, half), left
            else:
                left, right = right, left ^ _round(right, key, half)
        y[todo] = left << W.U64(half) | right
        todo[todo] = y[todo] >= n
    return y.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """What the mix takes from one source: ``slots`` slots, the last one ``last`` words."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def _seed(source: int, epoch: int) -> int:
    return SEED + 1_000_003 * source + 7_919 * epoch


def plan(name: str | None, k: int, size: int, target: float, block: int) -> Source:
    """How many slots give ``round(target)`` words."""
    words = int(np.floor(target + 0.5))
    if not size or not words:
        return Source(name, size, target, 0, 0, 0)
    blocks = -(-size // block)
    short = size - (blocks - 1) * block
    epochs, rest = divmod(words, size)
    if not rest:
        last = int(permuted(np.array([blocks - 1]), blocks, _seed(k, epochs - 1))[0])
        return Source(name, size, target, blocks, epochs * blocks, short if last == blocks - 1 else block)
    place = int(permuted(np.array([blocks - 1]), blocks, _seed(k, epochs), inverse=True)[0])
    slots = -(-rest // block)
    gap = block - short if place < slots else 0
    slots = -(-(rest + gap) // block)
    if place == slots - 1 and not gap:
        gap = block - short
        if slots * block - gap < rest:
            slots += 1
    length = short if place == slots - 1 else block
    return Source(name, size, target, blocks, epochs * blocks + slots, length - (slots * block - gap - rest))


def halved(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of ``counts`` slots of each source go to the first ``n`` of them all: a random draw of that total."""
    draw = np.random.default_rng(seed)
    left = draw.binomial(counts, n / counts.sum())
    while gap := n - int(left.sum()):
        room = counts - left if gap > 0 else left
        step = np.minimum(draw.multinomial(abs(gap), room / room.sum()), room)
        left = left + step if gap > 0 else left - step
    return left


@dataclass(frozen=True)
class Range:
    """Some consecutive shards: the first, how many, and by source their slots and the number of the first slot."""

    shard: int
    n: int
    counts: np.ndarray
    first: np.ndarray

    def halves(self, shard_slots: int, seed: int) -> tuple[Range, Range]:
        n = self.n // 2
        left = halved(self.counts, n * shard_slots, [seed, self.shard, self.n])
        return Range(self.shard, n, left, self.first), Range(self.shard + n, self.n - n, self.counts - left, self.first + left)

    def shards(self, shard_slots: int, seed: int) -> Iterator[Range]:
        """The single shards, in order."""
        todo = [self]
        while todo:
            range_ = todo.pop()
            if range_.n == 1:
                yield range_
            else:
                todo.extend(reversed(range_.halves(shard_slots, seed)))


def ranges(sources: list[Source], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> list[Range]:
    """All shards in up to ``NODES`` ranges; every shard has ``shard_slots`` slots, but for the last."""
    owed = np.array([s.slots for s in sources], dtype=np.int64)
    total = int(owed.sum())
    if not total:
        return []
    out = [Range(0, -(-total // shard_slots), owed, np.zeros_like(owed))]
    most = max(1, min(NODES, NODE_CELLS // len(sources)))
    while len(out) < most and any(r.n > 1 for r in out):
        out = [h for r in out for h in (r.halves(shard_slots, seed) if r.n > 1 else (r,))]
    return out


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words); other columns are left out."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))


def packed(sized: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds the source's number and each document's first word in its source's stream, ``start``."""
    order = F.xxhash64("doc_id", "size", F.lit(SEED))
    keyed = sized.join(numbers, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    buckets = F.ceil(F.col("docs") / BUCKET_DOCS)
    keyed = keyed.withColumn("_order", order).withColumn("_bucket", F.pmod("_order", buckets)).drop("docs")
    sums = keyed.groupBy("s", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("s", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("s", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return placed.join(bases, ["s", "_bucket"]).withColumn("start", F.col("_base") + F.col("_inner")).drop("_order", "_bucket", "_base", "_inner")


def slots(spark: SparkSession, sources: list[Source], block: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: source number, block index, words to take, shard, slot."""
    table = [(r.shard, r.n, r.counts.astype("<i8").tobytes(), r.first.astype("<i8").tobytes()) for r in ranges(sources, shard_slots)]
    blocks, total, last = (np.array([getattr(s, x) for s in sources], dtype=np.int64) for x in ("blocks", "slots", "last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = Range(row["shard"], row["n"], *(np.frombuffer(row[c], "<i8") for c in ("counts", "first")))
                for one in whole.shards(shard_slots, SEED):
                    for s in np.flatnonzero(one.counts).tolist():
                        j = np.arange(one.first[s], one.first[s] + one.counts[s])
                        at, epochs = np.empty(len(j), dtype=np.int64), j // blocks[s]
                        for epoch in np.unique(epochs).tolist():
                            mine = epochs == epoch
                            at[mine] = permuted(j[mine] % blocks[s], int(blocks[s]), _seed(s, epoch))
                        take = np.where(j == total[s] - 1, last[s], block)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), s)), pa.array(at), pa.array(take), pa.array(np.full(len(j), one.shard)), pa.array(j)], names=["s", "block", "take", "shard", "slot"])

    rows = spark.createDataFrame(table, "shard long, n long, counts binary, first binary")
    return rows.mapInArrow(run, "s long, block long, take long, shard long, slot long")


@dataclass(frozen=True)
class Mix:
    """A mix: its sources in order, the packed documents and the pieces taken.

    ``pieces`` has one row per document and slot: s (source number), shard,
    slot, block, start (the document's place in its source), first (the piece's
    first word in the document) and n (words).
    """

    sources: list[Source]
    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK) -> Mix:
    sized = written(sizes(docs), "mix-sizes")
    totals = [(r["source"], r["n"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goals = targets([n for _, n, _ in totals], weights, share, repeats)
    sources = [plan(name, k, n, goal, block) for k, ((name, n, _), goal) in enumerate(zip(totals, goals, strict=True))]
    rows = [(k, s.name, s.size, float(s.target), n) for k, (s, (_, _, n)) in enumerate(zip(sources, totals, strict=True))]
    numbers = sized.sparkSession.createDataFrame(rows, "s long, _name string, source_size long, target double, docs long")
    documents = written(packed(sized, F.broadcast(numbers) if len(rows) <= BROADCAST_SOURCES else numbers), "mix-packed")
    whole = documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    joined = whole.join(slots(sized.sparkSession, sources, block), ["s", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    pieces = joined.select("s", "shard", "slot", "block", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("n")).where("n > 0")
    return Mix(sources, documents, pieces)


def taken(mixed: Mix) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, the words taken, and how many shards took some, from the first."""
    # A set of shards is as large as its document at most; documents without words share their start with the next one.
    sums = mixed.pieces.groupBy("s", "start").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    names = ["doc_id", "source", "size", "source_size", "target"]
    none = [F.lit(0).cast("long").alias(c) for c in ("taken", "n_shards")]
    empty = mixed.documents.where("size = 0").select(*names, *none, F.lit(None).cast("long").alias("first_shard"))
    some = mixed.documents.where("size > 0").join(sums, ["s", "start"], "left")
    some = some.select(*names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.size("shards")).cast("long").alias("n_shards"), F.get("shards", F.lit(0)).alias("first_shard"))
    return some.union(empty)


def shard_mix(mixed: Mix) -> DataFrame:
    """Per output shard and source: shard, source and the words that the shard takes from it."""
    names = mixed.documents.select("s", "source").distinct()
    return mixed.pieces.groupBy("shard", "s").agg(F.sum("n").alias("words")).join(names, "s").select("shard", "source", "words")
