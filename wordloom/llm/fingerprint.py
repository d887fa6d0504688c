"""Document fingerprints by one-permutation MinHash, with SQL functions only.

Every 5-word shingle is hashed once.  The hash's top bits choose one of ``BINS``
bins, the rest is its rank there; each bin keeps the least.  An empty bin copies
the first non-empty one in a pseudorandom order of bins of its own, the same for
all documents (optimal densification).  The fingerprint packs the ``BITS`` low
bits of every bin in hexadecimal; as such bits also agree by chance, the
likeness of two fingerprints is corrected for 2**-BITS.

Scale: a document's fingerprint needs that document only, and is computed once.
Neighbours in doc_id order are found in ranges of some thousand documents, each of
which also gets the first document of the next; no task sees more than a range.
Ranges lie between quantiles of quantiles, so that clustered ids share them too;
rows of one doc_id (all null ones, say) are spread by a hash of their text.

Defined results: a null text is empty; a text without words has an empty
fingerprint, which is like another empty one (1) and unlike all others (0);
fewer than five words are one shingle; words are lower-cased; documents are in
order of doc_id (null first), then of a hash of the text, then text; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.store import limited, written

SHINGLE_WORDS = 5
BINS = 256
BITS = 8
#: Documents of a range, on average, and the ranges that each level is cut into at most.
RANGE_DOCS = 4_000
RANGES = 256
#: Bins that an empty one looks at before it ranks all non-empty bins.
PROBES = 6

_SHIFT = 63 - (BINS.bit_length() - 1)
_LOW = (1 << _SHIFT) - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Hashes of all k-word shingles; with fewer words, of the whole sequence."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        none = F.array().cast("array<bigint>")
        return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(none)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def _least(hashes: Column) -> Column:
    """The least value of each bin, in order; an empty bin has its largest value."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), _SHIFT).bitwiseOR(F.lit(_LOW)))
    values = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))
    ordered = F.sort_array(F.concat(values, edges))
    bin_ = lambda v: F.shiftright(v, _SHIFT)
    return bound(ordered, lambda a: F.filter(a, lambda v, i: (i == 0) | (bin_(v) != bin_(F.get(a, F.greatest(i - 1, F.lit(0)))))))


def _full(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW)


def _dense(least: Column) -> Column:
    """Fills empty bins; bin i looks at bins begin + t * step, t = 0, 1, ..., modulo BINS."""

    def fill(bins: Column, full: Column) -> Column:
        def look(value: Column, i: Column) -> Column:
            def at(begin: Column, step: Column) -> Column:
                probes = [F.get(bins, (begin + t * step) % BINS) for t in range(PROBES)]
                # The step's inverse modulo BINS, by Newton's rule, gives each full bin's place in the order.
                inverse = step
                for _ in range(2):
                    inverse = F.pmod(inverse * F.pmod(2 - step * inverse, F.lit(BINS)), F.lit(BINS))
                place = bound(inverse, lambda x: F.array_min(F.transform(full, lambda j: F.pmod((j - begin) * x, F.lit(BINS)))))
                found = F.coalesce(*[F.when(_full(p), p) for p in probes], F.get(bins, ((begin + place * step) % BINS).cast("int")))
                return found

            begin = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(BINS)).cast("int")
            step = F.pmod(F.xxhash64(i, F.lit(2)), F.lit(BINS // 2)).cast("int") * 2 + 1
            pair = F.struct(begin.alias("b"), step.alias("s"))
            return F.when(_full(value), value).otherwise(bound(pair, lambda p: at(p["b"], p["s"])))

        return F.transform(bins, look)

    places = lambda bins: F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: _full(F.get(bins, j)))
    return bound(least, lambda bins: bound(places(bins), lambda full: fill(bins, full)))


def signature(text: Column) -> Column:
    """The low bits of all bins, as numbers; empty for a text without words."""

    def of(hashes: Column) -> Column:
        low = F.transform(_dense(_least(hashes)), lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))
        return F.when(F.size(hashes) > 0, low).otherwise(F.array().cast("array<smallint>"))

    return bound(shingle_hashes(text), of)


def packed(signature: Column) -> Column:
    """A signature as a hexadecimal string."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint"))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity behind two signatures, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, corrected).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def _cut(rows: DataFrame, level: str, by: list[str]) -> DataFrame:
    """Adds ``level``: each group's rows in ranges of ``_key`` of about ``RANGE_DOCS``, ``RANGES`` at most."""
    quantiles = F.expr(f"percentile_approx(_key, array({', '.join(f'{i / RANGES}D' for i in range(RANGES))}), {10 * RANGES})")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), quantiles.alias("_q")).where("_n > 0")
    # Of the fine quantiles every so many, as many as the group has ranges.
    want = F.least(F.lit(RANGES), F.ceil(F.col("_n") / RANGE_DOCS)).cast("int")
    bounds = F.array_distinct(F.transform(F.sequence(F.lit(0), want - 1), lambda i: F.get("_q", F.floor(i * RANGES / want).cast("int"))))
    sizes = written(sizes.select(*by, bounds.alias("_bounds")), "next-bounds")
    joined = rows.join(limited(sizes, 16 * RANGES), by) if by else rows.join(F.broadcast(sizes))  # one row
    return joined.withColumn(level, F.greatest(F.lit(0), F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))) - 1)).drop("_bounds")


def with_next(docs: DataFrame, id_: str, text: str, derived: dict[str, Column]) -> DataFrame:
    """Adds ``derived`` columns, and ``next_<column>`` of them and the text from the next row in order of ``id_`` (after the last: the first)."""
    lowest = -(1 << 63)
    known = docs.withColumns({"_key": F.coalesce(F.col(id_), F.lit(lowest)), "_tie": F.xxhash64(text)})
    placed, levels, reach = known, [], docs.count()
    while not levels or reach > RANGE_DOCS:
        placed = _cut(placed, f"_l{len(levels)}", levels)
        levels, reach = [*levels, f"_l{len(levels)}"], reach / RANGES
    # An id of many rows is spread once more, by its ties; the rows after it in its range come behind its parts.
    counts = placed.groupBy(*levels, "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * RANGE_DOCS)
    many = counts.groupBy(*levels).agg(F.collect_list(F.struct(F.col("_key").alias("key"), F.ceil(F.col("_n") / RANGE_DOCS).cast("int").alias("parts"))).alias("_many"))
    placed = placed.join(limited(written(many, "next-many")), levels, "left").withColumn("_many", F.array_max(F.filter("_many", lambda m: m["key"] <= F.col("_key"))))
    part = F.least(F.col("_many.parts") - 1, F.floor((F.col("_tie").cast("double") / 2.0**64 + 0.5) * F.col("_many.parts")).cast("int"))
    inner = F.when(F.col("_many.key") == F.col("_key"), part).otherwise(F.when(F.col("_many").isNotNull(), F.col("_many.parts")).otherwise(F.lit(0)))
    placed = placed.withColumn("_at", F.struct(*levels, F.coalesce("_many.key", F.lit(lowest)).alias("many"), inner.alias("part")))
    firsts = written(placed.groupBy("_l0", "_at").agg(F.min(F.struct("_key", "_tie")).alias("_first")), "next-firsts")
    # A range's first row goes to the range before as a guest: found by a window within the first level, by the last ranges across.
    before = F.lag("_at").over(Window.partitionBy("_l0").orderBy("_at"))
    ends = firsts.groupBy("_l0").agg(F.max("_at").alias("_last")).orderBy("_l0").collect()  # at most RANGES rows
    crossing = [(r["_l0"], tuple(ends[k - 1]["_last"])) for k, r in enumerate(ends)]
    crossing = docs.sparkSession.createDataFrame(crossing, f"_l0 int, _end {firsts.schema['_at'].dataType.simpleString()}")
    hosts = firsts.withColumn("_host", before).join(F.broadcast(crossing), "_l0").select("_first._key", "_first._tie", F.coalesce("_host", "_end").alias("_at"))
    guests = known.join(limited(written(hosts, "next-hosts")), ["_key", "_tie"]).dropDuplicates(["_at"])
    names = [*docs.columns, "_key", "_tie", "_at", "_guest"]
    rows = placed.withColumn("_guest", F.lit(0)).select(*names).union(guests.withColumn("_guest", F.lit(1)).select(*names))
    along = Window.partitionBy("_at").orderBy("_guest", "_key", "_tie", text)
    out = rows.withColumns(derived).withColumns({f"next_{c}": F.lead(c).over(along) for c in (text, *derived)})
    return out.where("_guest = 0").drop("_key", "_tie", "_at", "_guest")


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as many first characters of the following one."""
    size = F.floor(n_chars / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - size), F.substring(following, F.lit(1), size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and likenesses to that and to the next document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(plain, "doc_id", "text", {"mark": signature(F.col("text"))})
    n_chars = F.char_length("text").cast("long")
    rows = rows.select("doc_id", n_chars.alias("n_chars"), "mark", "next_mark", edited(F.col("text"), n_chars, F.col("next_text")).alias("edited"))
    rows = rows.withColumn("edited_mark", signature(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), packed(F.col("mark")).alias("fingerprint"), packed(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
