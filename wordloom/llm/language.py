"""Language identification of mixed-language text.

A word is a run of letters and combining marks.  The script of its first letter
narrows the languages: only those whose training letters use that script can
label it (all of them, if none does).  Each word is scored for each language by
hashed character 3-grams, 4-grams and the word itself (add-one-half smoothed log
probabilities).  Viterbi over these scores, with a penalty for each switch,
labels spans of words; the document's language is the one that labels the most
letters.

Scale: prediction is one pass without shuffle; long texts cost linear time, as
Viterbi runs over blocks of ``STEP`` words at once and then over blocks.
Training counts come from a sample of about ``SAMPLE`` rows a language (a
documented bound, drawn by text hash); a task counts one language at a time.
There is no limit on languages: the model has a column for each, and rows only
for n-grams that were seen.  Only languages that some script of a slice allows
take part in its Viterbi, which needs memory in proportion to them.

Defined results: ``und`` with score 0 where a text is null or has no letter, or
where nothing could be learned; rows are judged one by one; extra columns are
kept by ``identified`` and ignored by ``predictions``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import words as W
from wordloom.llm.store import limited, written

BUCKETS = 1 << 17
SAMPLE = 5_000
PENALTY = 12.0
STEP = 64
#: A language uses a script that holds this share of its training letters.
SCRIPT_SHARE = 0.02
UNDETERMINED = "und"
#: Tasks that count, at most; each takes whole languages.
TASKS = 16
_FINE = 1 << 40

#: First code points of Unicode blocks, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Hangul"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x1B000, "Kana"),
    (0x1B170, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _classes() -> np.ndarray:
    """By code point: 0 for no letter, 255 for a combining mark, else 1 + script."""
    starts = np.array([a for a, _ in SCRIPTS])
    numbers = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], dtype=np.uint8)
    script = numbers[np.searchsorted(starts, np.arange(0x110000), side="right") - 1] + 1
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kind = np.array(kinds)
    return np.where(kind == "L", script, np.where(kind == "M", 255, 0)).astype(np.uint8)


@dataclass
class Text:
    """The words of some texts: features by bucket, script, letters; documents' offsets."""

    offsets: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    position_words: np.ndarray
    buckets: list[np.ndarray]
    word_bucket: np.ndarray


def read(column: pa.Array) -> Text:
    texts = pc.fill_null(pc.utf8_lower(column), "").to_pylist()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    kinds = _classes()[points]
    inside = kinds > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return Text(np.zeros(len(bounds), np.int64), none, none, none, [none, none], none)
    letters = np.add.reduceat(((kinds > 0) & (kinds < 255)).astype(np.int64), starts)
    # Marks alone are no word's script: 0.
    at = np.where(kinds[starts] == 255, 0, kinds[starts]).astype(np.int64)
    line = np.where(inside, points, 0).astype(np.uint32)
    pad = np.concatenate([[0, 0], line, [0, 0]]).astype(np.uint32)
    places = np.flatnonzero(inside)

    def gram(*shifts: int) -> np.ndarray:
        h = np.full(len(places), len(shifts), dtype=np.uint32)
        for s in shifts:
            h = (h ^ pad[places + 2 + s]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h % np.uint32(BUCKETS)).astype(np.int64)

    word = np.cumsum(first)[places] - 1
    spelt = W.mix(points.astype(W.U64))
    total = W.prefix_sums(spelt)
    whole = (W.span_hash(total, starts, ends) % W.U64(BUCKETS)).astype(np.int64)
    return Text(np.searchsorted(starts, bounds), letters, at, word, [gram(-1, 0, 1), gram(-2, -1, 0, 1)], whole)


@dataclass
class Model:
    """Log probabilities by feature kind, n-gram and language; scripts each language uses.

    ``index`` has each bucket's row in ``tables``; row 0 is for n-grams never seen.
    """

    languages: list[str]
    index: np.ndarray
    tables: list[np.ndarray]
    allowed: np.ndarray

    def scores(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """The languages that some word's script allows, and their scores: one row per word."""
        columns = np.flatnonzero(self.allowed[np.unique(text.script)].any(axis=0))
        some = slice(None) if len(columns) == len(self.languages) else columns
        n = len(text.letters)
        out = self.tables[2][self.index[2, text.word_bucket]][:, some]
        starts = np.searchsorted(text.position_words, np.arange(n))
        for k, buckets in enumerate(text.buckets):
            out = out + np.add.reduceat(self.tables[k][self.index[k, buckets]][:, some], starts, axis=0)
        return columns, np.where(self.allowed[text.script][:, some], out, out.min(axis=1, keepdims=True) - np.float32(1e4))


def _count_rows(docs: DataFrame) -> DataFrame:
    """Per language, whose rows come together: distinct buckets and counts of each kind, and letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, scripts = None, np.zeros((3, BUCKETS), dtype=np.int64), np.zeros(256, dtype=np.int64)

        def finished() -> pa.RecordBatch:
            seen = [np.flatnonzero(c) for c in counts]
            kinds = [*((k, b.astype("<i4").tobytes(), counts[k][b].astype("<i8").tobytes()) for k, b in enumerate(seen)), (3, b"", scripts.tobytes())]
            counts[:], scripts[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array([now] * 4, pa.string()), *(pa.array(list(x)) for x in zip(*kinds, strict=True))], names=["lang", "kind", "buckets", "counts"])

        for batch in batches:
            names = batch.column("lang").to_pylist()
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if names[a] != now:
                    if now is not None:
                        yield finished()
                    now = names[a]
                for part in W.slices(batch.slice(a, b - a), limit=1 << 19):
                    text = read(part.column("text"))
                    for k, buckets in enumerate([*text.buckets, text.word_bucket]):
                        counts[k] += np.bincount(buckets, minlength=BUCKETS)
                    scripts += np.bincount(text.script, weights=text.letters, minlength=256).astype(np.int64)
        if now is not None:
            yield finished()

    return docs.select("text", "lang").mapInArrow(run, "lang string, kind long, buckets binary, counts binary")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from columns text and lang; rows with a null in either are left out."""
    known = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.expr(f"bigint(floor({_FINE} * least(1.0D, {sample} / n)))").alias("share"))
    picked = known.join(limited(written(sizes, "lang-sizes")), "lang").where(F.pmod(F.xxhash64("text"), F.lit(_FINE)) < F.col("share"))
    found = written(_count_rows(picked.repartition(TASKS, "lang").sortWithinPartitions("lang")), "lang-counts")
    # Which n-grams any language has, then one column per language.
    languages, seen = [], np.zeros((3, BUCKETS), dtype=bool)
    for row in found.select("lang", "kind", "buckets").toLocalIterator():
        if row["kind"] < 3:
            seen[row["kind"], np.frombuffer(row["buckets"], "<i4")] = True
        else:
            languages.append(row["lang"])
    languages.sort()
    place = {x: k for k, x in enumerate(languages)}
    index = np.where(seen, np.cumsum(seen, axis=1), 0).astype(np.int32)
    tables = [np.zeros((int(seen[k].sum()) + 1, len(languages)), dtype=np.float32) for k in range(3)]
    scripts = np.zeros((len(languages), 256), dtype=np.int64)
    for row in found.toLocalIterator():
        k, x, counts = row["kind"], place[row["lang"]], np.frombuffer(row["counts"], np.int64)
        if k == 3:
            scripts[x] = counts
        else:
            total = np.log(counts.sum() + 0.5 * BUCKETS)
            tables[k][:, x] = np.log(0.5) - total
            tables[k][index[k, np.frombuffer(row["buckets"], "<i4")], x] = np.log(counts + 0.5) - total
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T.copy()
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, index, tables, allowed)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float, step: int | None = None) -> np.ndarray:
    """The best label of every word, where each change of label within a document costs ``penalty``.

    Exact.  Max-plus products of blocks of ``step`` words run for all blocks at
    once, then one short pass per document joins the blocks.
    """
    n, k = scores.shape
    # Blocks no shorter than the labels are many keep the products as small as the scores.
    step = step or max(STEP, k)
    small = np.uint8 if k <= 256 else np.uint32
    counts = np.diff(offsets)
    blocks = -(-counts // step)
    of_block = np.concatenate([[0], np.cumsum(blocks)])
    total = int(of_block[-1])
    within = np.arange(n) - np.repeat(offsets[:-1], counts)
    row, column = np.repeat(of_block[:-1], counts) + within // step, within % step
    padded = np.zeros((total, step, k), dtype=np.float32)
    padded[row, column] = scores
    penalty = np.float32(penalty)

    reach = np.full((total, k, k), -np.inf, dtype=np.float32)
    reach[:, np.arange(k), np.arange(k)] = 0
    for t in range(step):
        best = reach.max(axis=2, keepdims=True) - penalty
        np.maximum(reach, best, out=reach)
        reach += padded[:, t, None, :]
    # Only differences matter: numbers stay small however long a text is.
    reach -= reach.max(axis=(1, 2), keepdims=True)

    state = np.zeros((len(counts), k), dtype=np.float32)
    entry = np.zeros((total, k), dtype=np.float32)
    by_length = np.argsort(-blocks, kind="stable")
    for b in range(int(blocks.max(initial=0))):
        live = by_length[: int(np.searchsorted(-blocks[by_length], -b, side="left"))]
        at = of_block[live] + b
        entry[at] = state[live]
        new = (state[live][:, :, None] + reach[at]).max(axis=1)
        state[live] = new - new.max(axis=1, keepdims=True)

    back = np.empty((total, step, k), dtype=small)
    current, own = entry, np.arange(k, dtype=small)
    for t in range(step):
        top = current.argmax(axis=1)
        best = current[np.arange(total), top] - penalty
        stay = current >= best[:, None]
        back[:, t] = np.where(stay, own, top[:, None].astype(small))
        current = np.maximum(current, best[:, None]) + padded[:, t]
    origin = np.tile(own, (total, 1))
    for t in range(step - 1, -1, -1):
        origin = np.take_along_axis(back[:, t], origin.astype(np.int64), axis=1)
    end = np.zeros(total, dtype=np.int64)
    label = state.argmax(axis=1)
    for b in range(int(blocks.max(initial=0)) - 1, -1, -1):
        live = by_length[: int(np.searchsorted(-blocks[by_length], -b, side="left"))]
        at = of_block[live] + b
        end[at] = label[live]
        label[live] = origin[at, label[live]]
    labels = np.empty((total, step), dtype=np.int64)
    for t in range(step - 1, -1, -1):
        labels[:, t] = end
        end = back[np.arange(total), t, end].astype(np.int64)
    return labels[row, column]


def _judge(model: Model, column: pa.Array, penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    text, n = read(column), len(model.languages)
    names, shares, spans = [UNDETERMINED] * len(column), [0.0] * len(column), [[] for _ in range(len(column))]
    if not n or not len(text.letters):
        return names, shares, spans
    columns, scores = model.scores(text)
    labels = columns[viterbi(scores, text.offsets, penalty)]
    doc = np.repeat(np.arange(len(column)), np.diff(text.offsets))
    votes = np.bincount(doc * n + labels, weights=text.letters, minlength=len(column) * n).reshape(-1, n)
    total, best = votes.sum(axis=1), votes.argmax(axis=1)
    new = np.ones(len(labels), dtype=bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(labels)))
    for f, m in zip(first.tolist(), size.tolist(), strict=True):
        spans[doc[f]].append({"lang": model.languages[labels[f]], "first_word": f - int(text.offsets[doc[f]]), "n_words": m})
    for i in np.flatnonzero(total).tolist():
        names[i], shares[i] = model.languages[best[i]], float(votes[i, best[i]] / total[i])
    return names, shares, spans


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def predictions(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """Per document: doc_id, lang_pred, score (its share of the letters) and the labelled spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=1 << 19):
                names, shares, spans = _judge(shared.value, part.column("text"), penalty)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>")


def identified(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """The documents whose language can be told, columns unchanged."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, limit=1 << 19):
                found, _, _ = _judge(shared.value, part.column("text"), penalty)
                yield part.filter(pa.array([x != UNDETERMINED for x in found], pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept apart from training: crc32 of the doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
