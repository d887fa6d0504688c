"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  Every window has an anchor: the
``PHRASE``-word phrase inside it with the least hash, the first of equals.
Equal windows have equal anchors, so a window that recurs in another document
has an anchor that recurs.

1. Anchors are hashed in one pass; those of two or more documents are confirmed
   as recurring phrases by a pre-aggregated group-by.
2. Each confirmed phrase is read from its first document and goes to a shard of
   the corpus' phrases.  Phrases of one first document share a shard, so that a
   copied text meets few shards.  An Aho-Corasick automaton is compiled from each
   shard, word numbers being its letters: a phrase has ``PHRASE`` letters and no
   match starts inside a word.
3. Every document that may hold a phrase of a shard is streamed through its
   automaton, which locates all occurrences.  Nothing else tells where a window
   can recur: a window without a located anchor is left out.
4. Windows with one located anchor in common form a passage.  Equal passages
   collapse to the first document that has them; where an anchor has several
   passages, the windows of these first ones are compared, by 96-bit hashes.

Scale: a shard has about ``AUTOMATON`` phrases and a task about ``PART_DOCS``
documents of one shard, however many meet it: the automaton is compiled anew for
each such part.  A document travels once per shard that it meets.  Hot passages
collapse before windows are spread; no group is gathered and nothing is capped.

Defined results: null and blank texts have no words and lose none; a document
of fewer words than a window loses none; rows that share a doc_id are one
document for "smaller doc_id", each judged by its own text; rows with a null
doc_id are kept whole and repeat nothing.  Extra columns are kept by
``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import words as W
from wordloom.llm.store import limited, unused, written

WINDOW = 50
PHRASE = 10
#: Phrases of one automaton, about.
AUTOMATON = 20_000
#: Documents, about, that one task streams through a shard's automaton.
PART_DOCS = 4_000
#: Rows of several columns that may be broadcast (about 100 MB in memory).
WIDE_ROWS = 1_000_000

_LOW, _HIGH = W.U64(0xFFFFFFFF), W.U64(32)
_SURROGATES, _LETTERS = 0xD800, 0x10FFFF - 0x800 - 16


def anchors(words: W.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' first words, their anchors' first words, and the phrase hashes by first word."""
    counts = words.counts
    n = np.maximum(counts - window + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], n)
    if not len(begin):
        return begin, begin, words.hashes[:0]
    total = W.prefix_sums(words.hashes)
    size = max(0, len(words.hashes) - phrase + 1)
    at = np.arange(size)
    hashes = W.span_hash(total, at, at + phrase)
    # The least hash over window - phrase + 1 places, by doubling; the place breaks ties.
    span, least = 1, (hashes & ~_LOW) | at.astype(W.U64)
    target = window - phrase + 1
    while span < target:
        step = min(span, target - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return begin, (least[begin] & _LOW).astype(np.int64), hashes


def _ids(part: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    """The row keys (doc_id, text hash) of some documents of a batch."""
    at = pa.array(doc)
    return [part.column("doc_id").take(at), part.column("h").take(at)]


def _anchor_rows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """The anchors of each row: phrase, doc_id, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words = W.split(part.column("text"))
                _, anchor, hashes = anchors(words, window, phrase)
                places = np.unique(anchor)
                doc = np.searchsorted(words.offsets, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(hashes[places])), *_ids(part, doc)], names=["phrase", "doc_id", "h"])

    return docs.mapInArrow(run, "phrase long, doc_id long, h long")


def _of_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ W.mix(doc.astype(W.U64) + W.U64(1)))


def _phrase_texts(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """The words, joined by spaces, of the phrases that each document is the first to have (``phrases``), with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                words = W.split(part.column("text"))
                _, anchor, hashes = anchors(words, window, phrase)
                lists = part.column("phrases")
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                wanted = _of_document(W.unsigned(lists.flatten().to_numpy(zero_copy_only=False)), owner)
                places = np.unique(anchor)
                doc = np.searchsorted(words.offsets, places, side="right") - 1
                own = _of_document(hashes[places], doc)
                # Each document gives its own phrases, from their first occurrences.
                first = np.unique(own, return_index=True)[1]
                first = first[np.isin(own[first], wanted)]
                places, doc = places[first], doc[first]
                data, spans = words.data.tobytes(), list(zip(words.starts.tolist(), words.ends.tolist(), strict=True))
                texts = [b" ".join(data[a:b] for a, b in spans[p : p + phrase]).decode() for p in places.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("shard").take(pa.array(doc)), pa.array(texts, pa.string())], names=["shard", "text"])

    return docs.mapInArrow(run, "shard long, text string")


class Automata:
    """Aho-Corasick automata over the phrases of one shard, word numbers as letters."""

    def __init__(self, texts: list[pa.Array], phrase: int, size: int = AUTOMATON):
        words = W.split(pa.concat_arrays(texts) if texts else pa.array([], pa.string()))
        letters = words.hashes.reshape(-1, phrase)
        letters = letters[np.unique(W.span_hash(W.prefix_sums(words.hashes), *(np.arange(len(letters)) * phrase + k for k in (0, phrase))), return_index=True)[1]] if len(letters) else letters
        self.parts, self.phrase = [], phrase
        size = min(size, _LETTERS // phrase)
        for k in range(0, len(letters), size):
            mine = letters[k : k + size]
            vocabulary, ids = np.unique(mine.ravel(), return_inverse=True)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            spelt = self._text(ids.ravel() + 1)
            for j in range(len(mine)):
                automaton.add_word(spelt[j * phrase : (j + 1) * phrase], j)
            automaton.make_automaton()
            self.parts.append((vocabulary, automaton))

    @staticmethod
    def _text(numbers: np.ndarray) -> str:
        numbers = numbers.astype(np.uint32) + np.uint32(16)
        numbers[numbers >= _SURROGATES] += np.uint32(0x800)
        return numbers.tobytes().decode("utf-32-le")

    def occurrences(self, words: W.Words) -> np.ndarray:
        """The first words of all occurrences in some documents."""
        found = []
        for vocabulary, automaton in self.parts:
            at = np.searchsorted(vocabulary, words.hashes)
            at[at == len(vocabulary)] = 0
            text = self._text(np.where(vocabulary[at] == words.hashes, at + 1, 0))
            found.append(np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - self.phrase + 1)
        places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        doc = np.searchsorted(words.offsets, places, side="right") - 1
        return places[places + self.phrase <= words.offsets[doc + 1]] if len(places) else places


_PASSAGE = "doc_id long, h long, first int, n int, phrase long, key_a long, key_b long, windows binary"


def _located(part: pa.RecordBatch, automata: Automata, window: int, phrase: int) -> pa.RecordBatch | None:
    """Runs of windows with one located anchor: row, place, length, hashes."""
    words = W.split(part.column("text"))
    located = np.zeros(len(words.hashes) + 1, dtype=bool)
    located[automata.occurrences(words)] = True
    begin, anchor, hashes = anchors(words, window, phrase)
    live = located[anchor]
    begin, anchor = begin[live], anchor[live]
    if not len(begin):
        return None
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(begin)))
    start, end = begin[first], begin[first] + n + window - 1
    total, other = W.prefix_sums(words.hashes), W.prefix_sums(W.mix(words.hashes ^ W.U64(0xE7037ED1A0B428DB)))
    cells = np.empty(len(begin), dtype=[("a", "<u8"), ("b", "<u4")])
    cells["a"] = W.span_hash(total, begin, begin + window)
    cells["b"] = (W.span_hash(other, begin, begin + window) >> _HIGH).astype(np.uint32)
    doc = np.searchsorted(words.offsets, start, side="right") - 1
    return pa.RecordBatch.from_arrays(
        [
            *_ids(part, doc), pa.array(start - words.offsets[doc], pa.int32()), pa.array(n, pa.int32()), pa.array(W.signed(hashes[anchor[first]])),
            pa.array(W.signed(W.span_hash(total, start, end))), pa.array(W.signed(W.span_hash(other, start, end))),
            pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(begin)).astype(np.int32) * np.int32(12)), pa.py_buffer(cells.tobytes())]),
        ],
        names=["doc_id", "h", "first", "n", "phrase", "key_a", "key_b", "windows"],
    )


def _passages(dealt: DataFrame, window: int, phrase: int) -> DataFrame:
    """Streams each shard's documents (after its phrases, which have no doc_id) through its automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, automata = None, [], None
        for batch in batches:
            shard, at, phrases = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "is_phrase"))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (at[1:] != at[:-1]) | (phrases[1:] != phrases[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if (shard[a], at[a]) != now:
                    now, texts, automata = (shard[a], at[a]), [], None
                rows = batch.slice(a, b - a)
                if phrases[a]:
                    texts.append(rows.column("text"))
                    continue
                if automata is None:
                    automata, texts = Automata(texts, phrase), []
                for part in W.slices(rows):
                    out = _located(part, automata, window, phrase)
                    if out is not None:
                        yield out

    return dealt.mapInArrow(run, _PASSAGE)


def _dealt(known: DataFrame, rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """Shards' phrases and the documents to stream through them, sorted: shard, part, is_phrase, doc_id, h, text."""
    recurring = rows.groupBy("phrase").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("phrase", "owner")
    recurring = written(recurring, "phrase-recurring")
    shards = max(1, -(-recurring.count() // AUTOMATON))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")
    routes = rows.join(limited(recurring.select("phrase", shard)), "phrase").select("doc_id", "h", "shard").distinct()
    routes = written(routes, "phrase-routes")
    parts = written(routes.groupBy("shard").agg(F.expr(f"int(ceil(count(*) / {PART_DOCS}))").alias("parts")), "phrase-parts")
    routed = routes.join(limited(parts), "shard").groupBy("doc_id", "h").agg(F.collect_list(F.struct("shard", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int").alias("part"))).alias("to"))
    routed = limited(written(routed, "phrase-routed"))
    documents = known.join(routed, ["doc_id", "h"]).select(F.explode("to").alias("to"), "doc_id", "h", "text").select("to.shard", "to.part", F.lit(False).alias("is_phrase"), "doc_id", "h", "text")
    owned = written(recurring.groupBy("owner").agg(F.collect_list("phrase").alias("phrases")).withColumn("shard", shard), "phrase-owned")
    firsts = known.join(limited(owned.select(F.col("owner").alias("doc_id"))), "doc_id", "left_semi").join(owned, F.col("doc_id") == F.col("owner")).select("shard", "phrases", "text")
    texts = _phrase_texts(firsts, window, phrase).join(limited(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    nothing = F.lit(None).cast("long")
    both = texts.select("shard", "part", F.lit(True).alias("is_phrase"), nothing.alias("doc_id"), nothing.alias("h"), "text").union(documents)
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("is_phrase"))


def _spread(passages: DataFrame) -> DataFrame:
    """One row per window of the given passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "windows"):
                n = part.column("n").to_numpy()
                cells = np.frombuffer(b"".join(part.column("windows").to_pylist()), dtype=[("a", "<u8"), ("b", "<u4")])
                offsets = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - part.column("first").to_numpy(), n)
                columns = [
                    *_ids(part, np.repeat(np.arange(part.num_rows), n)), pa.array(place.astype(np.int32)),
                    pa.array(W.signed(cells["a"].copy())), pa.array(cells["b"].astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "first", "a", "b"])

    return passages.select("doc_id", "h", "first", "n", "windows").mapInArrow(run, "doc_id long, h long, first int, a long, b long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Runs of windows that also start in an earlier document: doc_id, h (the text's xxhash64), first, n (windows)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null")
    rows = written(_anchor_rows(known, window, phrase), "phrase-anchors")
    passages = written(_passages(_dealt(known, rows, window, phrase), window, phrase), "phrase-passages")
    keys = ["phrase", "key_a", "key_b", "n"]
    firsts = written(passages.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "phrase-firsts")
    # All windows of a passage that an earlier document has whole.
    shared = written(firsts.where("least < most").drop("most"), "phrase-shared")
    whole = passages.drop("windows").join(limited(shared, WIDE_ROWS), keys).where("doc_id > least").select("doc_id", "h", "first", "n")
    # Windows of passages in their first documents, against those of other passages with the same anchor.
    several = written(firsts.groupBy("phrase").agg(F.count("*").alias("passages")).where("passages > 1").select("phrase"), "phrase-several")
    mixed = written(firsts.join(limited(several), "phrase").select(*keys, F.col("least").alias("doc_id")), "phrase-mixed")
    heads = passages.join(limited(mixed, WIDE_ROWS), [*keys, "doc_id"], "left_semi")
    spread = written(_spread(heads), "phrase-windows")
    least = spread.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "b", "low")
    single = spread.join(limited(written(least, "phrase-least"), WIDE_ROWS), ["a", "b"]).where("doc_id > low").select("doc_id", "h", "first", F.lit(1).alias("n"))
    return whole.union(single)


def _removed(docs: DataFrame, window: int, phrase: int) -> tuple[DataFrame, str]:
    """The documents with their repeated runs of windows as one more column (null where there is none), and its name."""
    of, at, runs = unused(docs, "run_id"), unused(docs, "run_text"), unused(docs, "runs")
    spans = repeated_spans(docs, window, phrase).groupBy(F.col("doc_id").alias(of), F.col("h").alias(at)).agg(F.collect_list(F.struct("first", "n")).alias(runs))
    spans = written(spans, "phrase-runs")
    ids, own = limited(spans.select(of, at)), (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(docs["text"]) == F.col(at))
    # Texts that lose nothing are not shuffled with those that do.
    same = docs.join(ids, own, "left_anti").withColumn(runs, F.lit(None).cast(spans.schema[runs].dataType))
    return docs.join(ids, own, "left_semi").join(spans, own).drop(of, at).unionByName(same), runs


def _cover(n_words: int, runs: pa.Scalar, window: int) -> np.ndarray:
    """Which of a document's words stay."""
    depth = np.zeros(n_words + 1, dtype=np.int32)
    if runs.is_valid:
        values = runs.values
        first, n = values.field("first").to_numpy(), values.field("n").to_numpy()
        np.add.at(depth, first, 1)
        np.add.at(depth, first + n + window - 1, -1)
    return np.cumsum(depth[:-1]) == 0


def _kept_words(part: pa.RecordBatch, name: str, window: int) -> Iterator[tuple[int, int, bytes]]:
    words = W.split(part.column("text"))
    data = words.data.tobytes()
    for i, runs in enumerate(part.column(name)):
        a, b = words.offsets[i], words.offsets[i + 1]
        stay = _cover(int(b - a), runs, window)
        kept = [data[s:e] for s, e in zip(words.starts[a:b][stay].tolist(), words.ends[a:b][stay].tolist(), strict=True)]
        yield int(b - a), int(b - a) - len(kept), b" ".join(kept)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept_words(part, runs, window)]
                n, gone, digest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, runs = _removed(plain, window, phrase)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents without their repeated words, other columns unchanged.

    A text that loses words becomes its kept words joined by spaces; a document
    that loses all of them goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts, stays = part.column("text").to_pylist(), []
                for i, (n, gone, kept) in enumerate(_kept_words(part, runs, window)):
                    texts[i] = kept.decode() if gone else texts[i]
                    stays.append(gone < n or not gone)
                at = part.schema.get_field_index("text")
                out = part.set_column(at, part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
                yield out.filter(pa.array(stays, pa.bool_())).select(names)

    names = docs.columns
    rows, runs = _removed(docs, window, phrase)
    return rows.mapInArrow(run, docs.schema)


def oracle(window: int = WINDOW) -> str:
    """``substring_dedup`` in DuckDB's SQL, window by window."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, pos, array_to_string(w[pos:pos + {window - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - {window} + 2)) AS pos FROM d)),
f AS (SELECT win, min(doc_id) AS low FROM p GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS place FROM p JOIN f USING (win) WHERE doc_id > low),
k AS (SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id),
o AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS rest FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM o
"""
