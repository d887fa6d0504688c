"""MinHash near-dedup with circulant signatures.

Two random permutations replace one per coordinate: the first scatters the
shingles over a universe of 2**32 values, the second, shifted circularly by k,
gives coordinate k.  Bands of coordinates propose candidates; every link is
confirmed by the Jaccard similarity of the whole shingle sets.

Scale: equal sets collapse to one class by a pre-aggregated group-by.  Classes
that share a band bucket are compared with the bucket's least class only, so a
group of n copies costs n comparisons.  Buckets that then still hold several
components go on with an exact prefix filter: two sets can reach the threshold
only if they share one of their rarest shingles.  Nothing is dropped and no
bucket is gathered in one task.

A class is known by its least doc_id and a hash of its set, as rows that share a
doc_id may have different sets; such classes are linked.

Defined results: a null, empty or blank text has no shingle and links with
nothing; fewer than five words are one shingle; rows that share a doc_id are
one document, linked by whatever links any of them, and each row is returned;
rows with a null doc_id stay apart (component null, kept).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import words as W
from wordloom.llm.components import connected
from wordloom.llm.store import limited, unused, written

SHINGLE_WORDS = 5
BANDS = 32
ROWS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85

_FIRST = 0x2545F4914F6CDD1D
_SALT_A, _SALT_B = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def signatures(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The circulant MinHash signatures of some non-empty sets, one row per coordinate."""
    spread = (W.mix(values ^ W.U64(_FIRST)) >> W.U64(32)).astype(np.uint32)
    out = np.empty((n, len(offsets) - 1), dtype=np.uint32)
    x, y = np.empty_like(spread), np.empty_like(spread)
    for k in range(n):
        # The second permutation of (first permutation + shift), modulo 2**32.
        np.add(spread, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[k] = np.minimum.reduceat(x, offsets[:-1])
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket number per band and document."""
    out = np.empty((signature.shape[1], bands), dtype=W.U64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, dtype=W.U64)
        for r in range(rows):
            h = W.mix(h * W.U64(0x100000001B3) + signature[b * rows + r])
        out[:, b] = h
    return out


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = W.split(batch.column("text"), W.SPACED_LOWER)
    return W.distinct(*W.shingles(words, k))


def _sums(values: np.ndarray, offsets: np.ndarray, salt: int) -> pa.Array:
    """A hash of each set: the sum of its values' hashes."""
    total = np.concatenate([np.zeros(1, W.U64), np.cumsum(W.mix(values ^ W.U64(salt)))])
    return pa.array(W.signed(total[offsets[1:]] - total[offsets[:-1]]))


def features(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """Set sizes, 128-bit set hashes and band buckets of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                values, offsets = _sets(part, k)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                buckets = np.zeros((0, bands), dtype=W.U64)
                if len(full):
                    buckets = band_hashes(signatures(values, np.append(offsets[:-1][full], offsets[-1]), bands * rows), bands, rows)
                counts = np.where(sizes > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), _sums(values, offsets, _SALT_A), _sums(values, offsets, _SALT_B), W.grouped(W.signed(buckets.ravel()), np.concatenate([[0], np.cumsum(counts)]), pa.int64())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _FEATURES)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """Every row's doc_id and set hash, as ``id``, and its distinct shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                values, offsets = _sets(part, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _sums(values, offsets, _SALT_A), W.grouped(W.signed(values), offsets, pa.int64())], names=["doc_id", "set_a", "shingles"])

    sets = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_a long, shingles array<long>")
    return sets.select(_node("doc_id").alias("id"), "shingles")


def _node(doc_id: str) -> Column:
    return F.struct(F.col(doc_id).alias("doc"), F.col("set_a").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                u, v = x.values.to_numpy(), y.values.to_numpy()
                both = np.sort(np.concatenate([u, v]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    of_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a struct<doc:long,set:long>, b struct<doc:long,set:long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id reachable by links of at least
    ``percent`` per cent Jaccard similarity; ``kept`` marks those documents.
    The defaults miss a pair at 85 % with a probability below 1e-8, one at 80 % with 3e-6.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(features(known, bands, rows, k), "near-features")
    sets = found.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "near-classes")
    firsts = sets.join(classes.select(F.col("class_id").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    rowed = firsts.select(_node("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = rowed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    members = written(rowed.join(limited(written(shared, "near-shared")), "bucket"), "near-buckets")

    # Every member against its bucket's least member.
    centre = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"))
    near = members.join(centre, "bucket").select(F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.n").alias("n_a"), F.col("n").alias("n_b"))
    pairs = written(near.where((F.col("a") != F.col("b")) & _close(percent)).select("a", "b").distinct(), "near-pairs")
    several = written(_several(found), "near-several")
    repeated = not several.isEmpty()
    edges = _links(known, pairs, percent, k)
    if repeated:
        edges = edges.union(_same_document(sets.join(limited(several), "doc_id"), classes))
    component = written(connected(edges), "near-components")

    # Buckets that still hold several components.
    state = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    rest = written(state.join(apart, "bucket").groupBy("id", "n", "component").agg(F.count("*").alias("buckets")), "near-rest")
    pairs = written(_rare_pairs(known, rest, percent, k).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    more = _links(known, pairs, percent, k)
    if not more.isEmpty():
        component = written(connected(edges.union(more)), "near-components")

    linked = component.select(F.col("id.doc").alias("class_id"), F.col("id.set").alias("set_a"), F.col("component.doc").alias("linked"))
    resolved = classes.join(linked, ["class_id", "set_a"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("linked", "class_id").alias("linked"))
    out = found.drop("bands").join(resolved, ["set_a", "set_b", "n_shingles"], "left")
    component_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("linked")).otherwise(F.col("doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component_id)
    if repeated:
        out = _one_id(out, several)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _several(rows: DataFrame) -> DataFrame:
    """The doc_ids whose rows have several sets."""
    known = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high"))
    return known.where("low < high").select("doc_id")


def _same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    of = rows.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"])
    of = of.select("doc_id", _node("class_id").alias("b")).distinct()
    least = of.groupBy("doc_id").agg(F.min("b").alias("a"))
    return of.join(least, "doc_id").where("a <> b").select("a", "b").distinct()


def _one_id(out: DataFrame, several: DataFrame) -> DataFrame:
    """Rows without a shingle follow the other rows of their doc_id."""
    theirs = out.where("n_shingles > 0").join(limited(several), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("theirs"))
    return out.join(theirs, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("theirs", "component_id").alias("component_id"))


def _close(percent: int) -> Column:
    """An exact bound: sets of these sizes may reach the threshold."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _links(docs: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    wanted = written(pairs.select(F.col("a.doc").alias("doc_id")).union(pairs.select("b.doc")).distinct(), "near-wanted")
    sets = written(shingle_sets(docs.join(limited(wanted), "doc_id", "left_semi"), k), "near-sets")
    return written(verified(pairs, sets, percent), "near-links")


def _rare_pairs(docs: DataFrame, rest: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs of different components that can reach the threshold.

    Two sets that do share one of their rarest ``n - ceil(percent * n) + 1``
    shingles under any common order.  Shingles held by one component alone come
    first in it and yield no pair, so edits of one text that differ in too many
    shingles of their own never meet.
    """
    texts = docs.join(limited(rest.select(F.col("id.doc").alias("doc_id"))), "doc_id", "left_semi")
    rows = shingle_sets(texts, k).select("id", F.explode("shingles").alias("shingle")).join(rest.select("id", "n", "component"), "id")
    rows = written(rows, "near-shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle", "df")
    ranked = rows.join(common, "shingle").groupBy("id", "n", "component").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("common"))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    alone = F.col("n") - F.size("common")
    prefix = ranked.select("id", "n", "component", "common", F.slice("common", F.lit(1), F.greatest(F.lit(0), length - alone).cast("int")).alias("prefix"))
    # left_: what a set still has from this shingle on; the first common one bounds the overlap.
    keyed = prefix.select("id", "n", "component", F.posexplode("prefix.shingle").alias("at", "shingle"), alone.alias("alone")).select("id", "n", "component", "shingle", (F.col("n") - F.col("alone") - F.col("at")).alias("left_"))
    keyed = written(keyed, "near-prefixes")
    left = keyed.select("shingle", F.col("id").alias("x"), F.col("n").alias("n_a"), F.col("left_").alias("left_a"), F.col("component").alias("of_a"))
    right = keyed.select(F.col("shingle").alias("same"), F.col("id").alias("y"), F.col("n").alias("n_b"), F.col("left_").alias("left_b"), F.col("component").alias("of_b"))
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = left.join(right, (F.col("shingle") == F.col("same")) & (F.col("of_a") < F.col("of_b")) & _close(percent) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, its columns unchanged; rows with a null doc_id stay."""
    name = unused(docs, "kept_id")
    near = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(limited(written(near, "near-kept")), docs["doc_id"].cast("long") == F.col(name), "left_semi")
    # Rows are shuffled by doc_id only if some of them share one.
    if not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def oracle(percent: int = PERCENT, k: int = SHINGLE_WORDS) -> str:
    """``near_duplicates`` in DuckDB's SQL: all pairs that share a shingle, then the least id along links."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + {k - 1}], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM (SELECT a AS doc_id, min(c)::BIGINT AS component_id FROM r GROUP BY a) c LEFT JOIN n ON n.doc_id = c.doc_id
"""
