"""Benchmark decontamination with training suffix arrays.

Each shard, a few MB of training documents, gets a word-level suffix array: the
places of its suffixes, sorted by their first words.  Test suffixes are sorted
likewise, and the two arrays meet by binary search of the shorter in the longer.
A test suffix thus finds the range of all training suffixes that begin with its
window; meetings that follow each other in both texts are one verbatim match, as
long as it can be, with its location in the document and in the item.  Hit words,
items and removals all follow from these longest matches.  The training array is
sparse: suffixes whose first words occur nowhere in the benchmark are left out.

Scale: one pass over the documents, no shuffle.  Arrays hold places and the first
``window`` words of each suffix, so memory is linear in a shard and in a part of
the benchmark, however long an item is; meetings are expanded ``PAIRS`` at a
time.  The benchmark travels to the executors in parts of about ``part_bytes``,
each a broadcast variable; a larger one takes one pass per part, each adding to
the rows of the pass before.

Defined results: null and blank texts have no words; items without words have
no window; items with a null id are ignored; repeated rows are judged one by
one; rows of one item_id count as one item; extra columns are ignored by
``contamination`` and kept by ``decontaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import words as W
from wordloom.llm.store import written

WINDOW_WORDS = 10
#: Benchmark text that is sent to the executors at once.
PART_BYTES = 8 << 20
#: Words a training suffix must share with some test suffix to enter the array.
GRAM = 3

#: Text of one shard.
SHARD_BYTES = 3 << 20
#: Meetings of a training and a test suffix that are expanded at once.
PAIRS = 1 << 20

_MATCH = "doc_id long, doc_start int, item_id long, item_start int, n_words int"
_HITS = "doc_id long, text string, n_words long, spans array<struct<begin:int,end:int>>, items array<long>, longest int"


def prefixes(line: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` word numbers from each place, as byte strings that sort like them."""
    cells = line[places[:, None] + np.arange(size)].astype(">u4")
    return np.ascontiguousarray(cells).view(f"S{4 * size}").ravel()


@dataclass
class Suffixes:
    """The test suffixes whose window has ``size`` words: distinct windows, sorted, and the places of each."""

    size: int
    keys: np.ndarray
    offsets: np.ndarray
    places: np.ndarray


class TestSuffixes:
    """The benchmark items as word numbers, one after the other with a 0 between, and their sorted suffixes."""

    __test__ = False

    def __init__(self, rows: list[tuple[int, str | None]], window: int):
        rows = [(i, t) for i, t in rows if i is not None and t is not None]
        words = W.split(pa.array([t for _, t in rows], pa.string()), W.ALNUM_LOWER)
        counts = words.counts
        self.vocabulary, numbers = np.unique(words.hashes, return_inverse=True)
        self.line = np.zeros(len(numbers) + len(rows), dtype=np.uint32)
        self.line[np.arange(len(numbers)) + words.docs] = numbers + 1
        self.starts = words.offsets[:-1] + np.arange(len(rows))
        self.items = np.array([i for i, _ in rows], dtype=np.int64)
        sizes = np.minimum(counts, window)
        self.gram = int(min([GRAM, window, *sizes[sizes > 0].tolist()]))
        self.tables, grams = [], [np.zeros(0, W.U64)]
        folded = self.fold(self.line.astype(W.U64))
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            n = counts[mine] - size + 1
            ends = np.cumsum(n)
            places = np.arange(int(ends[-1])) + np.repeat(self.starts[mine] - ends + n, n)
            keys = prefixes(self.line, places, size)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.tables.append(Suffixes(size, keys[new], np.append(new, len(keys)), places))
            grams.append(folded[places])
        self.grams = np.unique(np.concatenate(grams))

    def item_of(self, places: np.ndarray) -> np.ndarray:
        """The rows of the items that hold these places."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def fold(self, line: np.ndarray) -> np.ndarray:
        """Hashes of all runs of ``gram`` word numbers; those with the number 0 are 0."""
        n = len(line) - self.gram + 1
        if n <= 0:
            return np.zeros(0, dtype=W.U64)
        out, known = np.zeros(n, dtype=W.U64), np.ones(n, dtype=bool)
        for j in range(self.gram):
            x = line[j : j + n]
            out = (out ^ x) * W.U64(0x9E3779B97F4A7C15)
            known &= x > 0
        return np.where(known, W.mix(out) | W.U64(1), W.U64(0))


class SuffixArray:
    """The training suffixes of one shard that can match."""

    def __init__(self, words: W.Words, tests: TestSuffixes):
        at = np.searchsorted(tests.vocabulary, words.hashes)
        at[at == len(tests.vocabulary)] = 0
        numbers = np.where(tests.vocabulary[at] == words.hashes, at + 1, 0).astype(np.uint32) if len(tests.vocabulary) else np.zeros(len(at), np.uint32)
        # A 0 after every document: no match crosses it.
        n = len(words.offsets) - 1
        self.line = np.zeros(len(numbers) + n, dtype=np.uint32)
        self.line[np.arange(len(numbers)) + words.docs] = numbers
        self.bounds = words.offsets[:-1] + np.arange(n)
        # How many words from each place on are known, so that no suffix is read past one that is not.
        stops = np.flatnonzero(self.line == 0)
        folded = tests.fold(self.line.astype(W.U64))
        places = np.searchsorted(tests.grams, folded)
        places[places == len(tests.grams)] = 0
        self.live = np.flatnonzero((tests.grams[places] == folded) & (folded > 0)) if len(tests.grams) else np.zeros(0, np.int64)
        self.known = stops[np.searchsorted(stops, self.live)] - self.live if len(self.live) else self.live

    def meetings(self, table: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, of the suffixes that begin with one of the windows, and that window's number."""
        places = self.live[self.known >= table.size]
        keys = prefixes(self.line, places, table.size)
        if len(keys) <= len(table.keys):
            at = np.searchsorted(table.keys, keys)
            at[at == len(table.keys)] = 0
            hit = table.keys[at] == keys
            return places[hit], at[hit]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        low, high = (np.searchsorted(keys, table.keys, side=s) for s in ("left", "right"))
        n = high - low
        ends = np.cumsum(n)
        entries = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - ends + n, n)
        found, window = places[order[entries]], np.repeat(np.arange(len(n)), n)
        order = np.argsort(found, kind="stable")
        return found[order], window[order]

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1


def _runs(diagonal: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins meetings (``n`` of them from a place on) that follow each other on a diagonal."""
    order = np.lexsort((place, diagonal))
    d, p, n = diagonal[order], place[order], n[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return d[first], p[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class Matches:
    """Longest matches of a shard: document, first word there, row of the item, first word there, words."""

    doc: np.ndarray
    start: np.ndarray
    item: np.ndarray
    item_start: np.ndarray
    n: np.ndarray


def matches(words: W.Words, tests: TestSuffixes, pairs: int = PAIRS) -> Matches:
    """All maximal verbatim matches, of a window's words or more, of a shard's documents and the items."""
    array, found = SuffixArray(words, tests), [(np.zeros(0, np.int64),) * 3]
    for table in tests.tables:
        places, window = array.meetings(table)
        first, n = table.offsets[window], np.diff(table.offsets)[window]
        ends, begin, parts = np.cumsum(n), 0, []
        while begin < len(places):
            done = int(ends[begin - 1]) if begin else 0
            end = max(int(np.searchsorted(ends, done + pairs, side="right")), begin + 1)
            size = n[begin:end]
            at = np.arange(int(ends[end - 1]) - done) - np.repeat(ends[begin:end] - size - done - first[begin:end], size)
            p = np.repeat(places[begin:end], size)
            parts.append(_runs(p - table.places[at], p, np.ones(len(p), dtype=np.int64)))
            begin = end
        if parts:
            d, p, m = parts[0] if len(parts) == 1 else _runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            found.append((p, p - d, m + table.size - 1))
    p, t, n = (np.concatenate(x) for x in zip(*found, strict=True))
    doc, item = array.documents(p), tests.item_of(t)
    return Matches(doc, p - array.bounds[doc] if len(doc) else p, item, t - tests.starts[item] if len(item) else t, n)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every maximal verbatim match of a window's words or more: both locations and its length."""
    out = None
    for tests in _parts(benchmark, window, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in W.slices(batch, limit=SHARD_BYTES):
                    m = matches(W.split(part.column("text"), W.ALNUM_LOWER), shared.value)
                    columns = [part.column("doc_id").take(pa.array(m.doc)), pa.array(m.start, pa.int32()), pa.array(shared.value.items[m.item], pa.int64()), pa.array(m.item_start, pa.int32()), pa.array(m.n, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_start", "item_id", "item_start", "n_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MATCH)
        out = found if out is None else out.union(found)
    return out


def _parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[TestSuffixes]:
    """The benchmark in parts of about ``part_bytes``, none of which is collected before its turn."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part_bytes))
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        yield TestSuffixes([tuple(r) for r in mine.distinct().collect()], window)


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of some intervals, as disjoint ones in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def _hits(docs: DataFrame, tests: TestSuffixes) -> DataFrame:
    """Adds what a part of the benchmark matches to each document's spans, items and longest match."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=SHARD_BYTES):
                words = W.split(part.column("text"), W.ALNUM_LOWER)
                m = matches(words, shared.value)
                spans, items, longest = (part.column(c).to_pylist() for c in ("spans", "items", "longest"))
                order = np.argsort(m.doc, kind="stable")
                doc, start, item, n = m.doc[order], m.start[order], m.item[order], m.n[order]
                edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True) if len(doc) else ():
                    k = int(doc[a])
                    before = spans[k]
                    begin = np.append([s["begin"] for s in before], start[a:b]).astype(np.int64)
                    end = np.append([s["end"] for s in before], start[a:b] + n[a:b]).astype(np.int64)
                    spans[k] = [{"begin": x, "end": y} for x, y in zip(*(v.tolist() for v in _merged(begin, end)), strict=True)]
                    items[k] = sorted({*items[k], *np.unique(shared.value.items[item[a:b]]).tolist()})
                    longest[k] = max(longest[k], int(n[a:b].max()))
                columns = [part.column("doc_id"), part.column("text"), pa.array(words.counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64())), pa.array(longest, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "spans", "items", "longest"])

    return docs.mapInArrow(run, _HITS)


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256, contaminated and longest_match, from spans, items and longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sum(s["end"] - s["begin"] for s in spans) for spans in batch.column("spans").to_pylist()]
            items = batch.column("items").to_pylist()
            digests = [hashlib.sha256(",".join(sorted(str(i) for i in x)).encode()).hexdigest() for x in items]
            columns = [
                batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()),
                pa.array([h > 0 for h in hits], pa.bool_()), batch.column("longest").cast(pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])

    return found.drop("text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words, 0 if none)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"))
    found = found.withColumns({"spans": F.expr("cast(array() as array<struct<begin:int,end:int>>)"), "items": F.expr("cast(array() as array<bigint>)"), "longest": F.lit(0)})
    for k, tests in enumerate(_parts(benchmark, window, part_bytes)):
        found = _hits(written(found, "hits") if k else found, tests)
    return _digest(found)


def _clean(docs: DataFrame, tests: TestSuffixes) -> DataFrame:
    """The rows without a match in the part, each judged by its own text."""
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=SHARD_BYTES):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[matches(W.split(part.column("text"), W.ALNUM_LOWER), shared.value).doc] = False
                yield part.filter(pa.array(keep, pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark window, columns unchanged."""
    for k, tests in enumerate(_parts(benchmark, window, part_bytes)):
        docs = _clean(written(docs, "clean") if k else docs, tests)
    return docs


def oracle(window: int = WINDOW_WORDS) -> str:
    """``contamination`` in DuckDB's SQL: windows meet by equality, matches are runs of them on a diagonal."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT item_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS win FROM (SELECT *, least(len(w), {window}) AS k, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS pos FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM t),
p AS (SELECT doc_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS pos FROM d, s)),
m AS (SELECT doc_id, item_id, p.k, p.pos, p.pos - t.pos AS diagonal FROM p JOIN t ON p.k = t.k AND p.win = t.win),
r AS (SELECT DISTINCT *, pos - dense_rank() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos) AS run FROM m),
l AS (SELECT doc_id, count(*) + max(k) - 1 AS n FROM r GROUP BY doc_id, item_id, diagonal, run),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS place FROM (SELECT DISTINCT doc_id, pos, k FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS digest FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN (SELECT doc_id, max(n) AS longest FROM l GROUP BY doc_id) USING (doc_id)
"""
