"""Column functions on literal rows; expected values follow from the rules by hand."""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F
from wordloom.functions import grades, normalize, similarity, tokens


def _values(spark, rows: list[tuple], schema: str, *columns: Column) -> list[tuple]:
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [tuple(r)[1:] for r in table.select("_i", *columns).orderBy("_i").collect()]


def _each(spark, f: Callable[[Column], Column], inputs: list) -> list:
    return [r[0] for r in _values(spark, [(x,) for x in inputs], "x string", f(F.col("x")))]


ARABIC = [
    ("الرَّحْمَـٰنِ", "الرحمن"),
    ("عَلَىٰ", "علي"),
    ("مُوسَىٰ", "موسي"),
    ("أَرْسَىٰهَا", "ارساها"),
    ("يَـٰمُوسَىٰ", "يا موسي"),
    ("ٱلصَّلَوٰةَ", "الصلاه"),
    ("ءَامَنُوا", "امنوا"),
    ("سؤال", "سءال"),
    ("ذَٰلِكَ", "ذلك"),
    ("بعد ما قال", "بعدما قال"),
    ("کتاب 12, (x)", "كتاب x"),
    ("", ""),
    (None, ""),
    ("4", ""),
    ("الربوا هنا", "الربا هنا"),
]


@pytest.mark.parametrize("given, wanted", ARABIC)
def test_normalize_arabic(spark, given, wanted):
    assert _each(spark, normalize.normalize_arabic, [given]) == [wanted]


def test_english(spark):
    given = ["It's (really) A  well-known\n“fact”.", "(all)", None, "a(b", "Ünïcode x2"]
    assert _each(spark, normalize.normalize_english, given) == ["its a wellknown fact", "", "", "a b", "n code x2"]


def test_strips(spark):
    assert _each(spark, normalize.strip_tags, ["a<b>c</b> <open", None]) == ["a c  <open", None]
    assert _each(spark, normalize.strip_open_tags, ["a<b>c <open"]) == ["ac "]
    assert _each(spark, normalize.alef_invariant, ["امنوا سءال"]) == ["منو سل"]
    assert _each(spark, normalize.strip_formulas, ["قال النبي صلي الله عليه وسلم خير", None]) == ["قال النبي خير", ""]
    assert _each(spark, normalize.strip_prefix, ["والكتاب", "الكتاب", "للبيت", "وقال", "الله", "من"]) == ["كتاب", "كتاب", "بيت", "قال", "له", "من"]
    assert _each(spark, lambda c: normalize.clean_matn(c, 2), ["a <i>b</i> c d"]) == ["a b"]


def test_strip_chain(spark):
    body = "حدثنا فلان عن فلان قال قال رسول الله صلي الله عليه وسلم الدين النصيحه"
    found = _values(spark, [(body,), ("كلام قصير",), ("كلام اخر لا سند له هنا",), ("سمعت فلانا يقول عن النبي",)], "x string", normalize.strip_chain(F.col("x")))
    assert (found[0][0].matn, found[0][0].stripped, found[0][0].offset) == ("الدين النصيحه", True, 12)
    assert [r[0].stripped for r in found[1:]] == [False, False, False] and found[2][0].matn == "كلام اخر لا سند له هنا"


def test_join_translations(spark):
    rows = [(["He said \"go", "and wait"],), (["one"],), (["a.", "", "b!"],)]
    assert [r[0] for r in _values(spark, rows, "x array<string>", normalize.join_translations(F.col("x")))] == ['He said "go, and wait."', "one", "a. b!"]


def test_word_similarity(spark):
    rows = [("قال", "قال", None), ("ءامن", "اامن", None), ("كتب", "كتاب", "كِتَٰب"), ("كتب", "كتاب", "كتاب"), ("الكتب", "الكتاب", "ٱلْكِتَٰب"), ("", "x", None), ("abcd", "abce", None)]
    found = [r[0].score for r in _values(spark, rows, "q string, s string, r string", similarity.word_similarity(F.col("q"), F.col("s"), F.col("r")))]
    assert found == [1.0, 1.0, 0.96, 0.40, 0.40, 0.0, 0.75]


def test_english_similarity(spark):
    rows = [("house", "house"), ("houses", "housed"), ("abcdefg", "abcdefx"), ("house", "mouse"), ("a", "abcd"), ("cat", "dog")]
    assert [r[0] for r in _values(spark, rows, "a string, b string", similarity.english_similarity(F.col("a"), F.col("b")))] == [1.0, 0.7, 0.9, 0.7, 0.0, 0.0]


def test_matching_words(spark):
    rows = [("حدثني", "حدثنا"), ("حدثني", "وحدثنا"), ("سءل", "سال")]
    assert [r[0] for r in _values(spark, rows, "a string, b string", similarity.equivalent(F.col("a"), F.col("b")))] == [True, False, True]
    rows = [("fasting", ["fast"]), ("fas", ["fast"]), ("abcdefgh", ["abcd"]), ("x", ["x"])]
    assert [r[0] for r in _values(spark, rows, "t string, s array<string>", similarity.in_set(F.col("t"), F.col("s")))] == [True, False, False, True]


def test_tokens(spark):
    found = _values(spark, [("قال النبي صلى الله عليه وسلم : نعم <br/> لا",)], "x string", tokens.kept_tokens(tokens.display_tokens(F.col("x"))))[0][0]
    assert [t.normalized for t in found] == ["قال", "النبي", "نعم", "لا"] and [t.place for t in found] == [0, 1, 7, 8]
    assert _each(spark, tokens.local_terms, ["What is the ruling on Smiling?", "is it"]) == [["ruling", "smiling"], ["is it"]]
    assert _each(spark, lambda c: tokens.content_tokens(c, "en"), ["Did the prophet smile, smile at home"]) == [["smile", "home"]]
    assert _values(spark, [("الكتاب", "The Book of 12 men")], "a string, e string", F.array_sort(tokens.index_tokens(F.col("a"), F.col("e")))) == [(["book", "men", "the", "الكتاب", "كتاب"],)]
    assert _values(spark, [(["a", "b", "a", "b"],)], "x array<string>", tokens.bigrams(F.col("x")), F.size(tokens.phrases(F.col("x"), 2, 3))) == [(["a b", "b a"], 5)]
    expanded = _values(spark, [(["charity begins"],)], "x array<string>", tokens.expand_terms(F.col("x")))[0][0]
    assert expanded[:3] == ["charity begins", "charity", "begins"] and "smiling" in expanded


def test_grades(spark):
    given = ["Sahih", "hasan sahih", "Mawdu", "Sahih Muslim (12)", "Daif Isnaad", "odd", None, "Maudu"]
    strict = _values(spark, [("n", g) for g in given], "n string, g string", grades.parse_grade(F.col("n"), F.col("g")))
    assert [r[0].family for r in strict] == ["صحيح", "حسن", "موضوع", "neutral", "ضعيف", "neutral", "neutral", "neutral"]
    assert strict[3][0].citation and strict[4][0].chain_only and strict[3][0].label.endswith("(Sahih Muslim (12))")
    assert _each(spark, grades.loose_family, given) == ["صحيح", "صحيح", "neutral", "صحيح", "ضعيف", "neutral", "neutral", "موضوع"]
    assert _each(spark, grades.external_family, ["Authentic", "good", "da'if", "fabricated", "صَحيح", None]) == ["صحيح", "حسن", "ضعيف", "موضوع", "صحيح", "neutral"]
    assert _each(spark, grades.collection_order, ["muslim", "other"]) == [2, 99]
