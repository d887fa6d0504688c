"""Questions answered whole, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from wordloom.functions import normalize, tokens
from wordloom.operators import align, evalkit, index, quota
from wordloom.plans import ask
from wordloom.sources import corpus
from wordloom.vocab import retrieval

COMMON, SHORT = ["zorbs", "quixy", "vlamp", "drone"], ["plonk", "grift"]


def _corpus():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [w for w in COMMON if rng.random() < 0.4] + [w for w in SHORT if rng.random() < 0.004] + ["xanthocroid"] * (i % 97 == 3) + rng.choices(["lorem", "ipsum", "dolor"], k=5)
        rng.shuffle(words)
        verse = i % 4 == 0
        # Numbers beyond those of the listed documents, which have a bonus.
        rows.append((f"ayah_{i + 5000}_1" if verse else f"{'bukhari' if i % 3 else 'nawawi'}_{i + 9500}", "ayah" if verse else "hadith", "", " ".join(words), "" if i % 8 else None))
    return rows


def _expected(asked: list[str], rows: list[tuple]) -> list[tuple[str, float]]:
    df = {t: sum(t in r[3].split() for r in rows) for t in asked}
    rare = {t for t in asked if len(t) >= 6 or df[t] <= len(rows) * 0.0075}
    hits = []
    for doc_id, kind, _, text, _ in rows:
        have = [t for t in asked if t in text.split()]
        if len(have) >= 2 or rare & set(have):
            hits.append((not rare & set(have), -len(have), doc_id, kind, text))
    scored = {"ayah": [], "hadith": []}
    for _, _, doc_id, kind, text in sorted(hits)[:150]:
        have = [t for t in asked if t in text]
        score = sum(25.0 if t in rare else 3.0 for t in have)
        scored[kind].append((-(score if rare & set(have) else 0.25 * score), doc_id, kind))
    cards = sorted(scored["ayah"])[:2] + sorted(scored["hadith"])[:4]
    order = {"bukhari": 9, "nawawi": 3, "ayah": 10}
    cards.sort(key=lambda c: (c[0], c[2] != "ayah", -order[c[1].split("_")[0]], [int(x) for x in c[1].split("_")[1:]]))
    return [(d, -s) for s, d, _ in cards if -s >= 0.6 * -cards[0][0]]


def test_cards_and_answers(spark):
    rows = _corpus()
    documents = spark.createDataFrame(rows, "doc_id string, doc_type string, arabic string, english string, commentary string")
    asked = {1: ["zorbs", "quixy"], 2: ["vlamp", "xanthocroid"], 3: ["zorbs", "vlamp", "drone", "plonk"], 4: ["nowhere"]}
    assert not any(w in x for w in [*COMMON, *SHORT, "nowhere"] for x in (retrieval.WEAK_TERMS, retrieval.RARE_TERMS, retrieval.GENERIC_TERMS, retrieval.STOP_WORDS))
    questions = spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()] + [(5, None), (6, "  ")], "query_id int, question string")
    found = {}
    for r in ask.keyword_cards(questions.where("query_id < 5"), documents, "en").orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, terms in asked.items():
        assert found.get(i, []) == [(d, pytest.approx(s)) for d, s in _expected(terms, rows)]
    assert len(found) == 3
    saying = retrieval.DENIED[0]
    out = {r.query_id: r for r in ask.answers(questions.union(spark.createDataFrame([(7, f"is it true: {saying[0][0]}")], "query_id int, question string")), documents, "en").collect()}
    assert out[7].verdict == "contradicted" and out[7].saying == saying[1] and out[7].cards == []
    assert [out[i].verdict for i in (4, 5, 6)] == ["unclear"] * 3 and out[2].cards == [d for d, _ in found[2]]
    # Both terms in one card attest the question whole.
    whole = any({"vlamp", "xanthocroid"} <= set(r[3].split()) for r in rows if r[0] in out[2].cards)
    assert out[2].lexical == (1.0 if whole else 0.5) and out[1].verdict == ("unclear" if out[1].top < 15 else "supported")


def test_helpers(spark, tmp_path):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("x")).first().x

    assert value(tokens.is_punctuation(F.lit("،"))) and not value(tokens.is_punctuation(F.lit("قال")))
    assert value(normalize.is_latin_only(F.lit("abc"))) and not value(normalize.is_latin_only(F.lit("abc قال"))) and value(normalize.has_latin(F.lit("قال a")))
    assert value(normalize.cache_key(F.lit("  The  Text "))) == "the text"
    arabic, latin = tokens.split_by_script(F.array(F.lit("صبر"), F.lit(" House"), F.lit("house"), F.lit("x")))
    assert value(arabic) == ["صبر"] and value(latin) == ["house"]
    window = value(align.best_query_window(F.split(F.lit(" ".join("abcdefghijklmnopqrstuvwxyz")), " "), F.array(F.lit("t"), F.lit("u"))))
    assert {"t", "u"} <= set(window) and len(window) < 26
    assert value(quota.skips_first_call(F.lit(3), F.lit(8))) and not value(quota.skips_first_call(F.lit(4), F.lit(8)))
    assert value(evalkit.fuzzy_overlap(F.array(F.lit("house"), F.lit("tree")), F.array(F.lit("hose"), F.lit("sea")))) == 1
    results = spark.createDataFrame([("negative", "matched"), ("negative", "not_found"), ("exact", "matched")], "category string, state string")
    assert evalkit.false_accepts(results).first().false_accepts == 1
    assert evalkit.text_memory(spark.createDataFrame([("abc",), ("é",)], "text string"), "text").first().bytes == 8
    verses = spark.createDataFrame([(1, 1, "The first, verse")], "chapter int, verse int, text string")
    r = index.indexed_verses(verses, "en").first()
    assert r.words == ["the", "first", "verse"] and r.alef == r.norm
    records = spark.createDataFrame([("bukhari", 1, "قال رسول الله صلى الله عليه وسلم الدين النصيحة"), ("bukhari", 2, "")], "collection string, number int, text string")
    r = index.record_index(records, ["collection", "number"]).collect()
    assert len(r) == 1 and r[0].matn[-1] == r[0].full[-1] and set(r[0].matn) <= set(r[0].full)
    docs = index.search_documents(
        spark.createDataFrame([(2, 255, "a", "b", "c")], "chapter int, verse int, arabic string, english string, commentary string"), spark.createDataFrame([("muslim", 7, "d", "e")], "collection string, number int, arabic string, english string")
    )
    assert sorted((x.doc_id, x.doc_type, x.commentary) for x in docs.collect()) == [("ayah_2_255", "ayah", "c"), ("muslim_7", "hadith", None)]
    assert corpus.with_lookup(verses, spark.createDataFrame([(1, "x")], "chapter int, name string"), ["chapter"]).first().name == "x"
    corpus.write_results(verses, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert corpus.read_commentary(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "chapters.json").write_text('{"chapters": [{"chapter": 1, "name": "n"}, {"chapter": 2, "englishname": "e", "arabicname": "a", "revelation": "Mecca"}]}')
    assert [tuple(x) for x in corpus.read_chapters(spark, str(tmp_path / "chapters.json")).orderBy("chapter").collect()] == [(1, "1", "n", ""), (2, "a", "e", "Mecca")]
