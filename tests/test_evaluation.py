"""Pass criteria, self-tests and limits, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from wordloom.operators import evalkit, quota
from wordloom.plans.search import verse_self_test

VERSE = {"id": "q1", "chapter": 2, "verse": 5, "confidence": 96.0, "matched_words": ["انما", "الاعمال", "بالنيات"]}
RECORD = {"id": "r1", "collection": "bukhari", "number": "1", "confidence": 80.0, "translation": "Actions (only) are by intentions."}
CASES = [
    ({}, {}, (True, None)),
    ({}, {"error": "HTTP 500"}, (False, None)),
    ({"state": "matched"}, {"state": "not_found"}, (False, "STATE")),
    ({"state_not": "matched"}, {"state": "matched"}, (False, "STATE")),
    ({"min_score": 90.0}, {"results": [RECORD]}, (False, None)),
    ({"min_score": 0.0}, {}, (False, None)),
    ({"changed_words": True}, {"results": [RECORD]}, (False, None)),
    ({"changed_words": True}, {"results": [RECORD | {"changed_words": ["x"]}]}, (True, None)),
    ({"top_retrieved": True, "state": "x"}, {"retrieved": ["r2", "r1"], "results": [RECORD]}, (False, "REF")),
    ({"top_retrieved": True}, {"retrieved": ["r1"], "results": [RECORD]}, (True, None)),
    ({"exclude_refs": ["r1"]}, {"results": [VERSE, VERSE, RECORD]}, (False, "REF")),
    ({"exclude_refs": ["r1"]}, {"results": [VERSE, VERSE, VERSE, RECORD]}, (True, None)),
    ({"english_slice": "are by, intentions", "ref": "other"}, {"results": [RECORD]}, (True, None)),
    ({"english_slice": "only"}, {"results": [RECORD]}, (False, "REF")),
    ({"collections": ["muslim"]}, {"results": [RECORD]}, (False, "REF")),
    ({"refs": ["zz", "2:5-7"]}, {"mode": "ayah", "query": "in english", "results": [VERSE, VERSE | {"verse_range": "5–7"}]}, (True, None)),
    ({"refs": []}, {"results": [RECORD]}, (False, "REF")),
    ({"ref": "zz, bukhari_1", "rank": 1}, {"query": "a", "results": [RECORD]}, (True, None)),
    ({"ref": "r1", "rank": 1}, {"query": "a", "results": [VERSE, RECORD]}, (False, "REF")),
    ({"ref": "r1"}, {"query": "a", "results": [VERSE, RECORD]}, (True, None)),
    ({"no_ref": True}, {"state": "matched", "results": [RECORD]}, (False, "REF")),
    ({"no_ref": True}, {"state": "close_match", "results": []}, (True, None)),
    ({"ref": "2:5", "query_words": ["انما", "الاعمال", "بالنيات"]}, {"mode": "ayah", "query": "انما", "results": [VERSE]}, (True, None)),
    ({"ref": "2:5", "query_words": ["كلام", "اخر"]}, {"mode": "ayah", "query": "انما", "results": [VERSE]}, (False, "HIGHLIGHT")),
    ({"ref": "2:5", "query_words": ["كلام", "اخر"]}, {"mode": "ask", "query": "انما", "results": [VERSE | {"id": "2:5"}]}, (True, None)),
]


def test_check_case(spark):
    table = spark.createDataFrame([(k, e, a) for k, (e, a, _) in enumerate(CASES)], f"k int, e struct<{_fields(evalkit.EXPECTED)}>, a struct<{_fields(evalkit.ACTUAL)}>")
    found = {r.k: (r.c.passed, r.c.reason) for r in table.select("k", evalkit.check_case(F.col("e"), F.col("a")).alias("c")).collect()}
    assert found == {k: want for k, (_, _, want) in enumerate(CASES)}


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


@pytest.mark.parametrize(("asked", "shown", "close", "good"), [("قال النبي", "قال النبي", False, True), ("قال النبي", "قال النبي صلي", False, False), ("قال صلي", "قال صلي", False, True), ("قال", "", False, False), ("كتاب", "كتاا", False, True), ("ا1 ب22 ج33", "ا1 ب22 زيدون", True, True), ("ا1 ب22 ج33", "ا1 ب22 زيدون", False, False)])
def test_highlight_quality(spark, asked, shown, close, good):
    table = spark.createDataFrame([(asked.split(), shown.split(), close)], "a array<string>, b array<string>, c boolean")
    assert table.select(evalkit.highlight_quality(F.col("a"), F.col("b"), F.col("c"))).first()[0] is good


def test_self_test_and_slowest(spark):
    verses = spark.createDataFrame([(1, 1, "the first verse speaks of morning light"), (1, 2, "another one tells of quiet rivers"), (2, 1, "")], "chapter int, verse int, text string")
    assert {(r.chapter, r.verse): r.passed for r in verse_self_test(verses, "en").collect()} == {(1, 1): True, (1, 2): True, (2, 1): False}
    runs = spark.createDataFrame([(str(i), float(i % 7)) for i in range(14)], "case string, duration double")
    assert [r.case for r in evalkit.slowest(runs, "case").collect()] == ["13", "6", "12", "5", "11"]


def test_failed_requests_do_not_count(spark, tmp_path):
    from wordloom.streaming.limits import limited_stream

    log = spark.range(20).select(F.col("id").alias("request"), F.lit("c").alias("client"), F.timestamp_millis(1_704_110_400_000 + F.col("id")).alias("ts"), (F.col("id") >= 8).alias("ok"))
    found = {r.request: r.allowed for r in quota.limited_requests(log, "client", "ts", "request", cap=100, success="ok").collect()}
    assert found == {i: i < 18 for i in range(20)}
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = limited_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), "client", "ts", "request", cap=100, success="ok")
    run = stream.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.request: r.allowed for r in spark.table("counted").collect()} == found


def test_unavailable_models(spark):
    start = 1_704_110_400_000
    log = spark.createDataFrame([(i, start + 1000 * i) for i in range(6)] + [(10, start + 3_600_000)], "request int, ms long").select("request", F.timestamp_millis("ms").alias("ts"))
    marks = spark.createDataFrame([("a", start + 1000)], "model string, ms long").select("model", F.timestamp_millis("ms").alias("ts"))
    found = {r.request: r.model for r in quota.acquire_available(log, marks, "ts", "request", {"a": 5, "b": 2}).collect()}
    assert found == {0: "a", 1: "a", 2: "b", 3: "b", 4: None, 5: None, 10: "a"}
    plain = {r.request: r.model for r in quota.acquire_models(log, "ts", "request", {"a": 5, "b": 2}).collect()}
    assert plain == {r.request: r.model for r in quota.acquire_available(log, marks.limit(0), "ts", "request", {"a": 5, "b": 2}).collect()}
