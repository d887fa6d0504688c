"""The operators on documents, against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from wordloom.llm import chat, fingerprint, language, licenses, mixing, phrase_dedup
from wordloom.llm import toxicity as tox
from wordloom.llm import words as W
from wordloom.llm.decontaminate import TestSuffixes, contamination, decontaminated, longest_matches, matches
from wordloom.llm.fingerprint import fingerprints, with_next
from wordloom.llm.near_dedup import near_duplicates, one_of_each
from wordloom.llm.phrase_dedup import deduplicated, substring_dedup
from wordloom.llm.toxicity import toxicity, train
from wordloom.llm.url_filter import filtered, matched, mined_rules

UPPER = str.maketrans({chr(c + 32): chr(c) for c in range(65, 91)})
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, run_id int, kept_id int, bad_id int, component_id long"


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdeéß", k=rng.randint(1, 4))) for _ in range(n)]


def _texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base, passage, line = _words(rng, 120), _words(rng, 70), _words(rng, 12)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n\v "), (4, "one"), (5, "One"), (6, "a b c"), (7, "a b c d e")]
    for i in range(10, 22):  # near copies
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = "new%d" % i
        rows.append((i, " ".join(copy)))
    rows += [(i, "  ".join(base).upper() if i % 2 else "\n".join(base)) for i in range(30, 36)]  # copies
    for i in range(40, 50):  # passages that documents share, at different places
        rows.append((i, " ".join(_words(rng, rng.randint(0, 30)) + passage[i % 7 : 70 - i % 3] + _words(rng, rng.randint(0, 30)) + line)))
    rows.append((60, " ".join(passage + passage + passage[:50])))
    rows.append((61, "  ".join(_words(rng, 60)) + " 日本 語"))
    rows.append((62, " ".join(_words(rng, 4000) + passage)))  # long
    rows += [(63, " ".join(line)), (63, " ".join(line)), (None, " ".join(base)), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[(i or 0) % 2] if i != 4 else None, None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), "x", 1, 2, 3, 4) for i, t in _texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text: str | None) -> frozenset:
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, empty):
    sets = {i: _shingles(t) for i, t in _texts() if i is not None}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    found = near_duplicates(docs).collect()
    assert len(found) == len(_texts())
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(4)
    p, x, y, z = (" ".join(_words(rng, 30)) for _ in range(4))
    rows = [(3, y), (5, y), (5, x), (9, x), (9, None), (11, z), (11, ""), (12, z), (20, None), (21, p)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_duplicates(table).collect())
    want = sorted((i, bool(t), {3: 3, 5: 3, 9: 3, 11: 11, 12: 11, 20: 20, 21: 21}[i], i in (3, 11, 20, 21)) for i, t in rows)
    assert found == want
    assert sorted(r.doc_id for r in one_of_each(table).collect()) == [3, 11, 20, 21]


def test_one_of_each(docs, empty):
    out = one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and 10 in named and 30 not in named and ids.count(None) == 2
    assert one_of_each(empty).count() == 0


def _removed() -> dict[int, tuple[int, list[bytes]]]:
    first: dict[tuple, int] = {}
    windows = {}
    for i, t in _texts():
        if i is not None:
            w = (t or "").encode().split()
            windows[i] = w
            for a in range(len(w) - 49):
                key = tuple(w[a : a + 50])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in windows.items():
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def test_substring_dedup(docs, empty):
    want, some = _removed(), 0
    for r in substring_dedup(docs).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        n, kept = want[r.doc_id]
        some += r.n_removed
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert some > 500
    assert substring_dedup(empty).count() == 0
    out = deduplicated(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    for i, t in _texts():
        if i is not None:
            n, kept = want[i]
            assert (i in texts) == (len(kept) > 0 or n == 0)
            if i in texts:
                assert texts[i] == (t if len(kept) == n else b" ".join(kept).decode())
    assert deduplicated(empty).count() == 0


def _dedup_rows() -> tuple[list, dict]:
    """Rows that share ids, and by (doc_id, text) the words that stay."""
    rng = random.Random(12)
    p, x, y = (_words(rng, n) for n in (60, 100, 70))
    rows = [(1, p), (2, p), (2, x), (2, y + p), (3, y[:55]), (3, x[:30] + p), (4, x + y), (None, p), (4, x + y)]
    least: dict[tuple, int] = {}
    for i, w in rows:
        for a in range(len(w) - 49):
            if i is not None:
                least[tuple(w[a : a + 50])] = min(least.get(tuple(w[a : a + 50]), i), i)
    want = defaultdict(list)
    for i, w in rows:
        gone = {k for a in range(len(w) - 49) if i is not None and least[tuple(w[a : a + 50])] < i for k in range(a, a + 50)}
        want[i].append([v for k, v in enumerate(w) if k not in gone])
    return rows, want


def test_rows_that_share_an_id_lose_their_own_words(spark):
    rows, want = _dedup_rows()
    docs = spark.createDataFrame([(i, "  ".join(w), "z") for i, w in rows], "doc_id long, text string, h string")
    found = defaultdict(list)
    for r in substring_dedup(docs).collect():
        found[r.doc_id].append((r.n_removed, r.kept_sha256))
    for i, kept in want.items():
        lengths = [len(w) for j, w in rows if j == i]
        assert sorted(found[i]) == sorted((n - len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for n, w in zip(lengths, kept, strict=True))
    assert sum(n for x in found.values() for n, _ in x) > 200
    texts = sorted((r.doc_id or 0, len(r.text.split())) for r in deduplicated(docs).collect())
    assert texts == sorted((i or 0, len(w)) for i, x in want.items() for w in x if w)


def test_only_the_automata_locate(spark, docs, monkeypatch):
    """Shards of few phrases and documents give the same; without occurrences nothing is removed."""
    monkeypatch.setattr(phrase_dedup, "AUTOMATON", 3)
    monkeypatch.setattr(phrase_dedup, "PART_DOCS", 2)
    want = _removed()
    for r in substring_dedup(docs).where("doc_id is not null").collect():
        assert r.n_removed == want[r.doc_id][0] - len(want[r.doc_id][1])
    phrases = pa.array(["a b c", "b c d", "x y z", "a b c"])
    words = W.split(pa.array(["a b c d", "a b", "c x y z"]))
    assert phrase_dedup.Automata([phrases], 3, 2).occurrences(words).tolist() == [0, 1, 7]
    assert phrase_dedup.Automata([], 3).occurrences(words).tolist() == []


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contamination(spark, docs, empty, part_bytes):
    texts = dict(_texts())
    items = [(1, " ".join((texts[44] or "").split()[5:30]).translate(UPPER)), (2, "b c"), (3, None), (4, " ... "), (None, "one"), (5, "nowhere to be found"), (10, " ".join((texts[44] or "").split()[10:22])), (1, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            if i is not None:
                windows[tuple(w[a : a + k])].add(i)
    sizes = {len(k) for k in windows}
    found = contamination(docs, benchmark, part_bytes=part_bytes).collect()
    assert len(found) == len(_texts())
    hit_any = 0
    for r in found:
        if r.doc_id is None:
            continue
        w = pattern.findall((texts[r.doc_id] or "").translate(LOWER))
        hit, owners = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    owners |= windows[tuple(w[a : a + k])]
        names = sorted(map(str, owners))
        hit_any += bool(hit)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert hit_any > 5
    if part_bytes > 1000:
        kept = decontaminated(docs, benchmark)
        assert kept.columns == docs.columns and not {4, 5, 44} & {r.doc_id for r in kept.collect()}
        longest = {(r.doc_id, r.item_id): r.n_words for r in longest_matches(docs, benchmark).collect()}
        assert longest[44, 1] == 25 and longest[44, 10] == 12 and longest[6, 2] == 2
    assert contamination(empty, benchmark).count() == 0
    assert contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_decontaminated_judges_rows(spark, empty, part_bytes):
    rows = [(None, "a leaked passage of the test"), (None, "clean words"), (None, None), (7, "one leaked passage of the test"), (7, "clean too"), (8, "another secret line here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bad_id string")
    benchmark = spark.createDataFrame([(1, "leaked passage of the test"), (2, "another secret line")], "item_id long, text string")
    out = decontaminated(docs, benchmark, part_bytes=part_bytes)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4]]))
    assert decontaminated(empty, benchmark).count() == 0 and decontaminated(docs, benchmark.limit(0)).count() == len(rows)


def test_long_items_take_linear_memory(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long[1000:1500] + ["x"] + long[5000:5004])), (2, "nothing here"), (3, " ".join(["again"] * 3000)), (4, " ".join(long[:120_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(long)), (8, " ".join(["again"] * 2000)), (9, "x"), (10, "nothing")], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_items, r.longest_match) for r in contamination(docs, benchmark).collect()}
    assert found == {1: (501, 2, 500), 2: (1, 1, 1), 3: (3000, 1, 2000), 4: (120_000, 1, 120_000)}
    spots = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words) for r in longest_matches(docs, benchmark).where("doc_id in (1, 4)").collect()}
    assert spots == {(1, 7): (0, 1000, 500), (1, 9): (500, 0, 1), (4, 7): (0, 0, 120_000)}


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_matches_against_all_pairs(pairs):
    rng = random.Random(9)
    docs = ["".join(rng.choices(["a ", "b ", "c "], k=rng.randint(0, 40))) for _ in range(12)]
    items = [(i, "".join(rng.choices(["a ", "b ", "c "], k=rng.randint(0, 12)))) for i in range(10)]
    want = set()
    for d, text in enumerate(docs):
        x = text.split()
        for i, item in items:
            y = item.split()
            k = min(4, len(y))
            for a in range(len(x)):
                for b in range(len(y)):
                    if k and (a == 0 or b == 0 or x[a - 1] != y[b - 1]):
                        n = 0
                        while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                            n += 1
                        if n >= k:
                            want.add((d, a, i, b, n))
    m = matches(W.split(pa.array(docs), W.ALNUM_LOWER), TestSuffixes(items, 4), pairs)
    found = list(zip(m.doc.tolist(), m.start.tolist(), m.item.tolist(), m.item_start.tolist(), m.n.tolist(), strict=True))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_mixing(docs, empty):
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 * 2 / 3, 250 / 3]) and mixing.targets([0, 10]) == [0, 15]
    for n in (1, 2, 3, 10, 257):
        x = np.arange(n)
        y = mixing.permuted(x, n, 9)
        assert sorted(y) == list(range(n)) and (mixing.permuted(y, n, 9, inverse=True) == x).all()
    first = mixing.taken(mixing.mix(docs, block=16)).toPandas()
    again = mixing.taken(mixing.mix(docs, block=16)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, first[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    assert len(first) == len(_texts()) and (first.taken <= 2 * first["size"]).all()
    for _, g in first.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert (first.loc[first["size"] == 0, ["taken", "n_shards"]] == 0).all(axis=None)
    assert mixing.taken(mixing.mix(empty)).count() == 0


def test_shards_draw_from_all_sources():
    sources = [mixing.Source(str(k), 0, 0.0, 1, n, 0) for k, n in enumerate([50_000, 20_000, 29_999, 0])]
    want = [sum(s.slots for s in sources) / 100_000 * s.slots / 100_000 for s in sources]
    shards = [one for r in mixing.ranges(sources, 1000) for one in r.shards(1000, mixing.SEED)]
    assert [one.shard for one in shards] == list(range(100)) and [int(one.counts.sum()) for one in shards] == [1000] * 99 + [999]
    counts = np.array([one.counts for one in shards])
    assert counts.sum(axis=0).tolist() == [s.slots for s in sources]
    assert (np.cumsum(counts, axis=0) - counts == np.array([one.first for one in shards])).all()
    # Multinomial spread: mean and variance of each source's share of a shard.
    for k, p in enumerate([0.5, 0.2, 0.3, 0.0]):
        assert abs(counts[:, k].mean() - 1000 * p) < 1
        assert 0.5 * 1000 * p * (1 - p) <= counts[:, k].var() <= 1.7 * 1000 * p * (1 - p)
    assert len(want) == 4 and mixing.ranges(sources[3:], 1000) == []
    # The same shards, however many ranges the driver draws for.
    again = [one.counts.tolist() for one in mixing.Range(0, 100, np.array([s.slots for s in sources]), np.zeros(4, np.int64)).shards(1000, mixing.SEED)]
    assert again == counts.tolist()


def test_mix_against_brute_force(docs):
    """Packing, slots and pieces once more, slot by slot in plain Python."""
    mixed = mixing.mix(docs, block=16)
    streams = defaultdict(list)
    for r in sorted(mixed.documents.collect(), key=lambda r: (r.s, r.start)):
        streams[r.s] += [(r.doc_id, r.size, k) for k in range(r.size)]
    words, by_shard = defaultdict(int), defaultdict(int)
    for one in (x for r in mixing.ranges(mixed.sources) for x in r.shards(mixing.SHARD_SLOTS, mixing.SEED)):
        for s, source in enumerate(mixed.sources):
            for j in range(int(one.first[s]), int(one.first[s] + one.counts[s])):
                at = int(mixing.permuted(np.array([j % source.blocks]), source.blocks, mixing._seed(s, j // source.blocks))[0])
                part = streams[s][at * 16 : at * 16 + (source.last if j == source.slots - 1 else 16)]
                by_shard[one.shard, source.name] += len(part)
                for i, size, _ in part:
                    words[i, size, source.name] += 1
    found = defaultdict(int)
    for r in mixing.taken(mixed).collect():
        found[r.doc_id, r["size"], r.source] += r.taken
    assert {k: v for k, v in found.items() if v} == dict(words)
    assert {(r.shard, r.source): r.words for r in mixing.shard_mix(mixed).collect()} == dict(by_shard)


def test_fingerprints(docs, empty):
    rank = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(_texts(), key=lambda r: (r[0] is not None, r[0] or 0, rank[r[1] or ""]))
    texts = [t or "" for _, t in rows]
    want = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want[i].append((len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    prints, errors = {}, []
    for r in fingerprints(docs).collect():
        match = next(w for w in want[r.doc_id] if w[:2] == (r.n_chars, r.edited_sha256))
        want[r.doc_id].remove(match)
        assert prints.setdefault(match[2], r.fingerprint) == r.fingerprint
        for other, near in ((match[3], r.near_edited), (match[4], r.near_next)):
            a, b = (frozenset(x.lower().split()[i : i + 5][0] + str(x.lower().split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))) if x.split() else frozenset() for x in (match[2], other))
            errors.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - near))
    assert not any(want.values()) and max(errors) < 0.2 and sum(errors) / len(errors) < 0.05
    assert fingerprints(empty).count() == 0


def test_neighbours_in_many_ranges(spark, monkeypatch):
    """Small ranges on several levels, ids in clusters, and ids that many rows share, between others."""
    monkeypatch.setattr(fingerprint, "RANGE_DOCS", 3)
    monkeypatch.setattr(fingerprint, "RANGES", 4)
    rng = random.Random(2)
    ids = [*range(20), *range(10**12, 10**12 + 15), *[77] * 30, *[None] * 17, *[-5] * 9, 78, 76]
    rows = [(i, f"t{rng.randrange(10**6)}") for i in ids]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rank = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, rank[r[1]]))
    nexts = {r: want[(k + 1) % len(want)][1] for k, r in enumerate(want)}
    found = with_next(table, "doc_id", "text", {"n": F.length("text")}).collect()
    assert len(found) == len(rows) and all(r.next_text == nexts[r.doc_id, r.text] and r.next_n == len(r.next_text) for r in found)


def test_language(spark, docs, empty):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "house", "with", "green", "water", "thing"], "fr": ["les", "maisons", "avec", "été", "une", "chose"], "el": ["το", "σπίτι", "νερό"]}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=rng.randint(3, 200))), x) for i, x in enumerate(rng.choices(list(vocabulary), k=300))]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "fr"), (1002, "the water", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.held_out(table.doc_id)
    model = language.fit(table.where(~held))
    found = {r.doc_id: r for r in language.predictions(table, model).collect()}
    assert len(found) == len(rows)
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[1000].score == 0
    assert sum(found[i].lang_pred == x for i, _, x in rows[:300]) >= 297
    mixed = spark.createDataFrame([(1, "the house with green water thing the house " * 3 + "les maisons avec une chose les maisons avec été " * 9)], "doc_id long, text string")
    spans = language.predictions(mixed, model).first()
    assert spans.lang_pred == "fr" and [s.lang for s in spans.spans] == ["en", "fr"] and 0.5 < spans.score < 1
    assert language.identified(table, model).count() == 301
    assert language.predictions(empty, model).count() == 0
    blank = language.fit(empty)
    assert {r.lang_pred for r in language.predictions(docs, blank).collect()} == {"und"}


def test_many_languages(spark):
    """300 languages, each with words of its own; plain Python scores the words once more."""
    rng = random.Random(7)
    own = {f"l{k:03}": _words(rng, 3) + ["".join(rng.choices("ghijklmnopqr", k=7)) for _ in range(3)] for k in range(300)}
    rows = [(i, " ".join(rng.choices(own[x], k=12)), x) for i, x in enumerate(list(own) * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table)
    assert len(model.languages) == 300 and sum(t.nbytes for t in model.tables) < 30 << 20
    found = {r.doc_id: r.lang_pred for r in language.predictions(table, model).collect()}
    assert sum(found[i] == x for i, _, x in rows) >= 890
    text = language.read(pa.array([rows[5][1]]))
    columns, scores = model.scores(text)
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(3)]
    for _, t, x in rows:
        whole = language.read(pa.array([t]))
        for k, buckets in enumerate([*whole.buckets, whole.word_bucket]):
            for b in buckets.tolist():
                counts[k][x][b] += 1
    for at, x in ((0, model.languages[0]), (5, rows[5][2])):
        want = 0.0
        for k, buckets in enumerate([*text.buckets, text.word_bucket]):
            total = sum(counts[k][x].values()) + 0.5 * language.BUCKETS
            mine = buckets[text.position_words == 0] if k < 2 else buckets[:1]
            want += sum(np.log((counts[k][x][b] + 0.5) / total) for b in mine.tolist())
        assert scores[0, columns.tolist().index(at)] == pytest.approx(want, rel=1e-4)


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k, counts = int(rng.integers(1, 5)), rng.integers(0, 40, size=4)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        scores = (rng.normal(size=(offsets[-1], k)) * 3).astype(np.float32)
        labels = language.viterbi(scores, offsets, 2.0, step=int(rng.integers(1, 9)))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if a < b:
                best = scores[a].astype(float)
                for t in range(a + 1, b):
                    best = np.maximum(best, best.max() - 2.0) + scores[t]
                path = labels[a:b]
                got = scores[np.arange(a, b), path].astype(float).sum() - 2.0 * (path[1:] != path[:-1]).sum()
                assert got == pytest.approx(best.max(), abs=1e-3)


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.2
        w = _words(rng, 80) + (["nasty%d" % rng.randint(0, 3)] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w) if i else None))
        marks.append((i, int(rng.random() < 0.5), int(bad) if i % 50 else None))
    marks += [(1, 0, marks[1][2]), (None, 1, 1), (5000, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = train(table, labels, {"low_quality": "1 - quality", "toxic": "toxic"})
    assert [len(m.extra) for m in chain.models] == [0, 1]
    found = toxicity(table, chain, "toxic").collect()
    truth = {i: t for i, _, t in marks if t is not None}
    assert sum(r.toxic == bool(truth[r.doc_id]) for r in found if r.doc_id in truth) >= 0.97 * 390
    assert toxicity(empty, chain, "toxic").count() == 0 and toxicity(docs, chain, "toxic").count() == len(_texts())
    none = train(table, labels.limit(0), {"toxic": "toxic"})
    assert not any(r.toxic for r in toxicity(table, none, "toxic").collect())


def test_chain_against_brute_force():
    """The chain's probabilities and threshold once more in plain Python."""
    rng = np.random.default_rng(3)
    n = 300
    lists = [np.unique(rng.integers(0, 40, size=rng.integers(1, 12))) for _ in range(n)]
    first = np.array([float(5 in x or rng.random() < 0.05) for x in lists])
    second = np.array([float((7 in x and a > 0) or rng.random() < 0.02) for x, a in zip(lists, first, strict=True)])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    chain = tox.fit_chain(np.concatenate(lists), offsets, np.column_stack([first, second]), ["one", "two"])
    p = chain.probabilities(np.concatenate(lists), offsets)
    for i, x in enumerate(lists):
        earlier = []
        for model in chain.models:
            z = model.bias + sum(model.weights[b] for b in x) + sum(w * e for w, e in zip(model.extra, earlier, strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
        assert p[i] == pytest.approx(earlier)
    score, y = rng.integers(0, 20, 200) / 20, rng.random(200) < 0.3
    f = lambda t: 5 * (y & (score >= t)).sum() / ((score >= t).sum() + 4 * y.sum())
    assert f(tox.best_threshold(score, y)) == pytest.approx(max(f(t) for t in np.unique(score)))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_toxicity_of_held_out_documents(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0
    chain = train(docs, labels.where(inside), {"low_quality": "1 - quality", "toxic": "toxic"})
    rows = toxicity(docs, chain, "toxic").join(labels.where(~inside).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    hits, flagged, bad = sum(r.toxic and r.truth for r in rows), sum(r.toxic for r in rows), sum(r.truth for r in rows)
    print(f"held out: {len(rows)} rows, {bad} toxic, recall {hits / bad:.3f}, precision {hits / flagged:.3f}, thresholds {chain.thresholds}")
    assert hits >= 0.9 * bad and hits >= 0.9 * flagged


def test_licenses(spark, empty):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, None), (2, ""), (3, "hello\nReleased under the MIT License.\nworld"), (4, "x " * 3000 + "\nLicensed under CC BY-NC 4.0.\nreleased under  the MIT license"), (5, mit.upper()), (5, mit.upper()), (6, "under the License")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3].license == "MIT" and found[3].dice == 1.0 and found[1].license is None and found[2].dice == 0.0
    assert found[4].licenses == "CC-BY-NC-4.0,MIT" and found[5].license == "MIT" and found[6].license is None
    assert licenses.scan(empty).count() == 0


def test_chat(spark):
    rng = random.Random(3)
    pieces = ["###", "### ", "</turn>", "</", "\\", "\n", ": ", ":", "#", "User", "user", "a", "é", ""]
    for _ in range(3000):
        role, text = ("".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(2))
        line, begin, end = chat.render(role, text)
        assert chat.parse(line) == [(role, text)]
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (None, 0, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, None, "assistant", "y" * 100_000)]
    found = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    text = "\\### Assistant: </turn> ok"
    assert found[-7].turns_sha256 == digest(("user", text), ("assistant", text)) and found[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert found[1].turns_sha256 == digest(("user", ""), ("assistant", "hi")) and found[1].loss_chars == 2
    assert found[2].n_turns == 2 and found[2].loss_chars == 0 and found[3].loss_chars == 100_000 and None in found
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_urls(spark):
    rows = [(1, None, "a"), (2, "no scheme", "b"), (3, "http://WWW.Example.com/en/x?y#z", "c"), (4, "http://example.com/en", "d"), (5, "https://a.example.com/en/", "e"), (6, "http://x.net/es/1", "f"), (7, "http://net", "g"), (8, "http://notnet/fr/", "h"), (9, "http://q.org", "i")]
    rows += [(100 + i, f"http://site{i % 3}.org/{'casino' if i % 2 else 'news'}/{i}", "x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(100 + i, i % 2 == 1) for i in range(40)] + [(None, True), (101, True)], "doc_id long, blocked boolean")
    found = {r.page_id: r for r in filtered(pages, labels).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("", "", None, "allow") and found[2].host == ""
    assert (found[3].host, found[3].path, found[3].rule, found[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert found[4].rule == "com/" and found[5].verdict == "block" and found[6].rule == "net/es/" and found[7].rule is None and found[8].rule is None
    assert all(found[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(60))
    assert filtered(pages.limit(0), labels).count() == 0 and filtered(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_urls_are_mined_whole(spark):
    host = ".".join("abcdefghijklmn")
    rows = [(i, f"https://{host}/x/{i}?q={i}&{'zz' if i % 2 else 'yy'}=1") for i in range(60)] + [(100, "https://other.org/?zz=2")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(40)], "doc_id long, blocked boolean")
    found = {r.page_id: r for r in filtered(pages, labels).collect()}
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(60)) and found[100].mined_confidence == 1.0


def test_mined_rules_are_exact(spark):
    rng, token = random.Random(8), "abcdefghijkl"
    sets = [sorted({t for t in token if rng.random() < 0.4} | ({"a", "b"} if k % 3 else set())) for k in range(120)]
    sets = [sorted(set(s) - ({"a", "b"} if not {"a", "b"} <= set(s) else set())) for s in sets]  # a and b always meet
    urls = [(s, ({"a", "k"} <= set(s) or {"d", "e"} <= set(s)) != (rng.random() < 0.1)) for s in sets]
    n, bad = defaultdict(int), defaultdict(int)
    for s, blocked in urls:
        for bits in range(1, 1 << len(s)):
            key = tuple(x for k, x in enumerate(s) if bits >> k & 1)
            n[key] += 1
            bad[key] += blocked
    rules = {k: bad[k] / n[k] for k in n if bad[k] >= 12 and bad[k] >= 0.75 * n[k]}
    least = {k: v for k, v in rules.items() if not any(k[:i] + k[i + 1 :] in rules for i in range(len(k)))}
    asked = [sorted(x) for x in {frozenset(rng.sample(token, rng.randint(1, 6))) for _ in range(200)}]
    want = {tuple(s): max(v) for s in asked if (v := [c for k, c in least.items() if set(k) <= set(s)])}
    mined = mined_rules(spark.createDataFrame(urls, "tokens array<string>, blocked boolean"), support=0.1, confidence=0.75)
    found = {tuple(r.tokens): r.confidence for r in matched(spark.createDataFrame([(s,) for s in asked], "tokens array<string>"), mined).collect()}
    assert len(least) > 3 and any("a" in k for k in least) and any(len(k) > 1 for k in least) and found == pytest.approx(want)
