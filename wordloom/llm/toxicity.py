"""Toxicity by a classifier chain.

The categories are predicted in order.  Each has a linear model (logistic
regression) over hashed words and word beginnings, plus one input per earlier category: that
category's probability.  In training, these probabilities are out of fold: they
come from models that did not see the row, so later models learn from inputs as
uncertain as those they meet in prediction.  A category's threshold is the one
with the best F-measure of its out-of-fold probabilities, recall counting
``RECALL`` times as much as precision.

Scale: training rows are a sample of about ``SAMPLE`` labelled rows (a documented
bound, drawn by hash of the doc_id).  Tasks count their word numbers first, and
only those that tell the labels apart are gathered, so long texts cost the driver
little; prediction is one pass over the documents without shuffle.  Models have
``BUCKETS`` weights.

Defined results: a null or blank text has no words and gets the bias' probability;
rows of ``labels`` that share a doc_id count as 1 in a category if any does, rows
without a label in a category are left out of its training; without any label of
both kinds, a category's probability is the share of 1 (0 without rows) and its
threshold 0.5.  Rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import words as W
from wordloom.llm.store import written

BUCKETS = 1 << 18
SAMPLE = 16_000
FOLDS = 5
#: Lengths in bytes of the word beginnings that count as inputs, as inflected words share them.
PREFIXES = (3, 4, 5, 6)
EPOCHS = 40
BATCH = 256
RATE = 0.3
DECAY = 1e-6
#: A word enters the models if this many training rows have it.
LEAST_ROWS = 3
#: ... and its share of the label differs from all rows' by this many standard errors.
LEAST_STRENGTH = 5.0
#: ... and this many, in all rows, to be gathered at all.
LEAST_GATHERED = 3.0
#: The threshold where nothing can be learned, and recall's weight in choosing others.
THRESHOLD, RECALL = 0.5, 2.0
_FINE = 1 << 40


def word_buckets(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct buckets, of words and of long words' beginnings, and their offsets."""
    found, docs, doc = [words.hashes], [words.docs], words.docs
    for n in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > n)
        starts = words.starts[long]
        found.append(W.mix(W.hash_spans(words.data, starts, starts + n, W.ALNUM_LOWER.codes) + W.U64(n)))
        docs.append(doc[long])
    owner = np.concatenate(docs)
    values = (np.concatenate(found) % W.U64(BUCKETS)).astype(np.int64)[np.argsort(owner, kind="stable")]
    return W.distinct(values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words.offsets) - 1))]))


@dataclass
class Rows:
    """Sparse rows: distinct buckets by row, and the earlier categories' probabilities."""

    buckets: np.ndarray
    offsets: np.ndarray
    extra: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[rows] - offsets[:-1], sizes)
        return Rows(self.buckets[at], offsets, self.extra[rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def probability(self, rows: Rows) -> np.ndarray:
        owner = np.repeat(np.arange(len(rows.offsets) - 1), np.diff(rows.offsets))
        total = np.bincount(owner, weights=self.weights[rows.buckets], minlength=len(rows.offsets) - 1)
        return _sigmoid(total + rows.extra @ self.extra + self.bias)


def fit_linear(rows: Rows, y: np.ndarray, seed: int = 7) -> Linear:
    """Logistic regression by AdaGrad over shuffled batches, with L2 decay."""
    n, width = len(y), rows.extra.shape[1]
    share = float(y.mean()) if n else 0.0
    model = Linear(np.zeros(BUCKETS), np.zeros(width), 0.0)
    if share in (0.0, 1.0):
        model.bias = 30.0 if share else -30.0
        return model
    model.bias = float(np.log(share / (1 - share)))
    seen = np.bincount(rows.buckets, minlength=BUCKETS)
    positive = rows.take(np.flatnonzero(y > 0))
    hits = np.bincount(positive.buckets, minlength=BUCKETS)
    del positive
    strength = np.abs(hits - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    known = np.flatnonzero((seen >= LEAST_ROWS) & (strength >= LEAST_STRENGTH))
    index = np.full(BUCKETS, -1, dtype=np.int32)
    index[known] = np.arange(len(known))
    # Only the inputs that stay, so that an epoch costs little.
    at = index[rows.buckets]
    before = np.concatenate([[0], np.cumsum(at >= 0)])
    rows = Rows(at[at >= 0], before[rows.offsets], rows.extra)
    size = len(known) + width + 1
    w, squares = np.zeros(size), np.full(size, 1e-8)
    w[-1] = model.bias
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for k in range(0, n, BATCH):
            part, target = rows.take(order[k : k + BATCH]), y[order[k : k + BATCH]]
            owner = np.repeat(np.arange(len(target)), np.diff(part.offsets))
            z = np.bincount(owner, weights=w[part.buckets], minlength=len(target)) + part.extra @ w[len(known) : -1] + w[-1]
            error = (_sigmoid(z) - target) / len(target)
            grad = np.bincount(part.buckets, weights=error[owner], minlength=size).astype(float)
            grad[len(known) : -1] = error @ part.extra
            grad[-1] = error.sum()
            grad[:-1] += DECAY * w[:-1]
            squares += grad * grad
            w -= RATE * grad / np.sqrt(squares)
    model.weights[known], model.extra, model.bias = w[: len(known)], w[len(known) : -1], float(w[-1])
    return model


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One column per category; each model sees the columns before its own."""
        out = np.zeros((len(offsets) - 1, 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(Rows(buckets, offsets, out))])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the probabilities where the F-measure is best; of equals the highest."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order] > 0
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.zeros(0, np.int64)
    if not len(p) or not y.any() or y.all():
        return THRESHOLD
    hits, square = np.cumsum(y)[last], RECALL**2
    k = int(np.argmax((1 + square) * hits / (last + 1 + square * y.sum())))
    return float((p[last[k]] + (p[last[k] + 1] if last[k] + 1 < len(p) else 0.0)) / 2)


def fit_chain(buckets: np.ndarray, offsets: np.ndarray, labels: np.ndarray, categories: list[str]) -> Chain:
    """Trains the chain; ``labels`` has one column per category, NaN where unknown."""
    n, models, thresholds = len(offsets) - 1, [], []
    earlier = np.zeros((n, 0))
    fold = np.arange(n) % FOLDS
    for c in range(len(categories)):
        rows, y = Rows(buckets, offsets, earlier), labels[:, c]
        known = ~np.isnan(y)
        models.append(fit_linear(rows if known.all() else rows.take(np.flatnonzero(known)), y[known]))
        out = np.zeros(n)
        for f in range(FOLDS):
            inner, outer = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            out[outer] = fit_linear(rows.take(inner), y[inner]).probability(rows.take(outer))
        thresholds.append(best_threshold(out[known], y[known]))
        earlier = np.column_stack([earlier, out])
    return Chain(categories, models, thresholds)


def _telling(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Which buckets enough rows have, with a share of some label that differs from all rows' share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hits, known = np.zeros(BUCKETS, np.int64), np.zeros((len(names), BUCKETS), np.int64), np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            seen += np.bincount(values, minlength=BUCKETS)
            for k, c in enumerate(names):
                y = np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(float), sizes)
                known[k] += np.bincount(values[~np.isnan(y)], minlength=BUCKETS)
                hits[k] += np.bincount(values[y > 0], minlength=BUCKETS)
        some = np.flatnonzero(seen)
        columns = [pa.array(some), *(pa.array(x[some]) for x in (*known, *hits))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"n{k}" for k in range(len(names))), *(f"y{k}" for k in range(len(names)))])

    fields = [f"{x}{k}" for x in "ny" for k in range(len(names))]
    sums = rows.select("buckets", *names).mapInArrow(count, "bucket long, " + ", ".join(f"{x} long" for x in fields)).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in fields])
    shares = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    found, out = sums.toArrow(), np.zeros(BUCKETS, dtype=bool)
    bucket = found.column("bucket").to_numpy()
    for k, c in enumerate(names):
        n, y, share = found.column(f"n{k}").to_numpy(), found.column(f"y{k}").to_numpy(), shares[c]
        if share is not None and 0 < share < 1:
            strength = np.abs(y - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
            out[bucket[(n >= LEAST_ROWS) & (strength >= LEAST_GATHERED)]] = True
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain:
    """Learns from documents with labels; ``categories`` maps names to SQL expressions over labels, in chain order."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_of"), *[F.expr(f"cast({e} as double)").alias(c) for c, e in categories.items()]).where("_of is not null")
    marks = marks.groupBy("_of").agg(*[F.max(c).alias(c) for c in categories])
    n = marks.count()
    pick = F.pmod(F.xxhash64("_of"), F.lit(_FINE)) < int(_FINE * min(1.0, sample / max(1, n)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks.where(pick), F.col("doc_id") == F.col("_of")).select("doc_id", "text", *categories)
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                values, offsets = word_buckets(W.split(part.column("text"), W.ALNUM_LOWER))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), W.grouped(values.astype(np.int32), offsets, pa.int32()), *[part.column(c) for c in names]], names=["doc_id", "buckets", *names])

    typed = ", ".join(f"{c} double" for c in names)
    rows = written(rows.mapInArrow(run, "doc_id long, buckets array<int>, " + typed), "toxicity-rows")
    telling = rows.sparkSession.sparkContext.broadcast(_telling(rows, names))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            stays = telling.value[values]
            offsets = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(sizes)])]
            yield batch.set_column(1, "buckets", W.grouped(values[stays], offsets, pa.int32()))

    table = rows.mapInArrow(keep, "doc_id long, buckets array<int>, " + typed).toArrow()
    chunks = [(c.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in table.column("buckets").chunks]
    parts, sizes = [b for b, _ in chunks], [n for _, n in chunks]
    ids = table.column("doc_id").to_numpy()
    marked = np.column_stack([table.column(c).to_numpy().astype(float) for c in names])
    del table, chunks
    if not len(ids):
        return fit_chain(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, len(names))), names)
    gathered = Rows(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.zeros((len(ids), 0)))
    del parts
    # In order of doc_id, so that folds and batches are the same in every run.
    order = np.argsort(ids, kind="stable")
    gathered = gathered.take(order)
    return fit_chain(gathered.buckets, gathered.offsets, marked[order], names)


def toxicity(docs: DataFrame, chain: Chain, flag: str, threshold: float | None = None) -> DataFrame:
    """Per document: doc_id, p_<category> for each, and ``flag``: its probability reaches the threshold (the chain's, if none is given)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                values, offsets = word_buckets(W.split(part.column("text"), W.ALNUM_LOWER))
                p = shared.value.probabilities(values, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, k].copy()) for k in range(p.shape[1])]], names=["doc_id", *names])

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names))
    return judged.withColumn(flag, F.col(f"p_{flag}") >= (chain.thresholds[chain.categories.index(flag)] if threshold is None else threshold))
