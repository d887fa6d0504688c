"""Operators on small tables, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from wordloom.functions.similarity import english_similarity
from wordloom.operators import align, evalkit, index, quota, record_match, retrieve, verse_match
from wordloom.sources import corpus


def _near(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def _aligned(q: list[str], s: list[str]) -> tuple[int, int, int, int]:
    """exact, near, gone and extra of the cheapest path, traced back."""
    m, n = len(q), len(s)
    cost = [[0.0] * (n + 1) for _ in range(m + 1)]
    back = [[""] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        cost[i][0], back[i][0] = 1.5 * i, "up"
        for j in range(1, n + 1):
            step = 0.0 if q[i - 1] == s[j - 1] else 0.5 if _near(q[i - 1], s[j - 1]) else 2.5
            options = [(cost[i - 1][j - 1] + step, 0, "diagonal"), (cost[i - 1][j] + 1.5, 1, "up"), (cost[i][j - 1] + 1.0, 2, "left")]
            cost[i][j], _, back[i][j] = min(options)
    end = n
    for j in range(min(n, max(1, m - 4)), n + 1):
        if cost[m][j] < cost[m][end]:
            end = j
    i, j, out = m, end, [0, 0, 0, 0]
    # Of equal columns the first wins, unless the last is as cheap.
    while i > 0:
        if back[i][j] == "diagonal":
            out[0 if q[i - 1] == s[j - 1] else 1 if _near(q[i - 1], s[j - 1]) else 2] += 1
            i, j = i - 1, j - 1
        elif back[i][j] == "up":
            out[2] += 1
            i -= 1
        else:
            out[3] += 1
            j -= 1
    return tuple(out)


def test_alignment(spark):
    rng = random.Random(4)
    vocabulary = ["ab", "abc", "xyz", "xyw", "qq", "long"]
    rows = [(i, rng.choices(vocabulary, k=rng.randint(0, 7)), rng.choices(vocabulary, k=rng.randint(0, 9))) for i in range(150)]
    table = spark.createDataFrame(rows, "i int, q array<string>, s array<string>")
    for r in table.withColumn("a", align.alignment(F.col("q"), F.col("s"))).collect():
        if r.q and r.s:
            exact, near, gone, extra = _aligned(r.q, r.s)
            assert (r.a.exact, r.a.near, r.a.gone, r.a.extra) == (exact, near, gone, extra), r
            assert r.a.confidence == int((exact + 0.85 * near) / len(r.q) * 100 + 0.5)
        else:
            assert r.a.confidence == 0


def test_windows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        q, s = rng.choices("abcdefgh", k=rng.randint(1, 5)), rng.choices("abcdefghijkl", k=rng.randint(1, 40))
        rows.append((i, q, s))
    table = spark.createDataFrame(rows, "i int, q array<string>, s array<string>")
    for r in table.select("q", "s", align.best_window(F.col("q"), F.col("s")).alias("w"), align.lcs_length(F.col("q"), F.col("s")).alias("l")).collect():
        m, n = len(r.q), len(r.s)
        if n <= m + 8:
            assert r.w == r.s
        else:
            hits = [sum(x in r.q for x in r.s[k : k + m]) for k in range(n - m + 1)]
            k = hits.index(max(hits))
            assert r.w == r.s[max(0, k - 4) : k + m + 6]
        row = [0] * (n + 1)
        for x in r.q:
            last, row = row, [0]
            for j, y in enumerate(r.s):
                row.append(max(last[j] + (x == y), last[j + 1], row[j]))
        assert r.l == row[-1]


def test_containment_and_greedy(spark):
    rows = [(["a", "b"], ["x", "a", "b"]), (["a", "b", "c"], ["a", "b"]), (["a", "b", "c", "d"], ["a", "b"]), ([], ["a"]), (["word"], ["ward", "wort"])]
    found = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q array<string>, r array<string>").orderBy("i").select(align.containment(F.col("q"), F.col("r"))).collect()]
    assert found == [100, 67, 0, 0, 75]
    greedy = spark.createDataFrame([(["ab", "zz", "cd", "ab"], "xx ab cd ab"), (["b", "a"], "a b")], "t array<string>, x string")
    assert [r[0] for r in greedy.select(align.greedy_in_order(F.col("t"), F.col("x"))).collect()] == [3, 1]


def test_verse_matching(spark):
    verses = spark.createDataFrame([(1, 1, "in the name of all".split()), (1, 2, "praise the lord of the worlds".split()), (1, 3, ["gracious", "merciful"]), (2, 1, "the lord of worlds knows".split())], "chapter int, verse int, words array<string>")
    queries = spark.createDataFrame([(1, "praise the lord of the worlds".split()), (2, "of the worlds gracious merciful".split()), (3, "prase the lord of the worlds".split()), (4, ["nothing", "matches", "here"]), (5, ["lord"])], "query_id int, words array<string>")
    found = {r.query_id: r for r in verse_match.match_verses(queries, verses, english_similarity).where("place = 1").collect()}
    assert (found[1].state, found[1].coverage, found[1].confidence) == ("matched", "full", 100)
    assert (found[2].start_verse, found[2].end_verse, found[2].coverage, found[2].state, found[2].confidence) == (2, 3, "fragment", "close_match", 89)
    assert found[3].state == "close_match" and found[3].confidence == 89 and 4 not in found and 5 not in found
    variants = verse_match.opening_variants(queries, ["praise", "the"], 1).where("query_id = 1").orderBy("variant").collect()
    assert [v.words for v in variants] == ["praise the lord of the worlds".split(), "lord of the worlds".split()] and variants[1].skip == 1


def test_record_matching(spark):
    text = "actions are judged by intentions and every person has what they intended"
    records = spark.createDataFrame([(1, "bukhari", 1, text.split()), (2, "muslim", 5, ("it is said that " + text).split()), (3, "nasai", 9, "something else entirely is here".split())], "record_id int, collection string, number int, full array<string>").withColumn("matn", F.col("full"))
    asked = [(1, text.split()), (2, text.replace("judged", "jugded").split()), (3, "entirely is here".split())]
    queries = spark.createDataFrame(asked, "query_id int, full array<string>").withColumn("matn", F.col("full")).withColumn("stripped", F.lit(False))
    from wordloom.plans.search import search_records

    found = {(r.query_id, r.record_id): r for r in search_records(queries, records).collect()}
    assert found[1, 1].place == 1 and found[1, 1].state == "matched" and found[1, 2].place == 2
    assert found[2, 1].state == "close_match" and found[3, 3].confidence == 100
    pairs = {(r.target, r.record_id): r.ratio for r in record_match.attestations(records, records).collect()}
    assert pairs[1, 2] == 1.0 and pairs[2, 1] == 1.0 and (1, 3) not in pairs


def test_verdicts(spark):
    rows = [(0, 99.0, "q", 1.0, 1.0), (1, 14.9, "q", 1.0, 1.0), (1, 15.0, "is it allowed", 1.0, 1.0), (1, 15.0, "q", 0.39, 1.0), (1, 15.0, "q", 0.69, 1.0), (1, 15.0, "q", 0.70, 0.49), (1, 15.0, "q", 0.70, 0.50)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n int, top double, q string, lexical double, aligned double").orderBy("i")
    found = [r[0] for r in table.select(retrieve.verdict(F.col("n"), F.col("top"), F.col("q"), F.col("lexical"), F.col("aligned"))).collect()]
    assert found == ["unclear", "unclear", "permissibility", "unclear", "permissibility", "permissibility", "supported"]


def test_retrieval(spark):
    questions = spark.createDataFrame([(1, "smiling at your brother counts as charity"), (2, "green tea")], "query_id int, question string")
    cards = spark.createDataFrame([(1, 1, "your smiling in the face of your brother is charity"), (2, 1, "nothing about it")], "query_id int, place int, text string")
    found = {r.query_id: r for r in retrieve.attestation(questions, cards, "en").collect()}
    assert found[1].lexical == 0.75 and found[1].aligned == 0.75 and found[2].lexical == 0.0
    assert spark.createDataFrame([("حب الوطن من الايمان",), ("hello",)], "q string").select(retrieve.denied(F.col("q")).isNotNull()).collect() == [(True,), (False,)]
    shared = spark.createDataFrame([("smiling is charity", "a smile is charity")], "q string, d string").select(retrieve.concepts_shared(F.col("q"), F.array(F.lit("smiling")), F.col("d"))).first()[0]
    assert shared == 2
    assert spark.createDataFrame([("", "he may marry four wives", "x")], "a string, e string, d string").select(retrieve.pair_bonus(F.col("a"), F.col("e"), F.col("d")), retrieve.phrase_bonus(F.col("a"), F.col("e"))).first() == (35.0, 40.0)


def _log(spark):
    start = 1_704_110_400_000  # an hour's start
    rows = [(i, "c1", start + 5_000 * i) for i in range(11)] + [(20, "c1", start + 60_000), (21, "c1", start + 60_001), (22, "127.0.0.1", start)] + [(100 + i, "127.0.0.1", start + i) for i in range(12)]
    return spark.createDataFrame(rows, "request int, client string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_request_limits(spark):
    found = {r.request: (r.allowed, r.reason) for r in quota.limited_requests(_log(spark), "client", "ts", "request", cap=100).collect()}
    assert all(found[i][0] for i in range(10)) and found[10] == (False, "PER_MINUTE_LIMIT") and found[20][1] == "PER_MINUTE_LIMIT" and found[21][0]
    assert all(found[100 + i][0] for i in range(12))
    capped = {r.request: r.reason for r in quota.limited_requests(_log(spark), "client", "ts", "request", cap=3).collect()}
    assert capped[2] is None and capped[3] == "PER_HOUR_IP_CAP" and quota.hourly_budget(500) == 16 and quota.client_cap({"a": 16, "b": 16, "c": 480}) == 102


def test_stream_equals_batch(spark, tmp_path):
    from wordloom.streaming.limits import limited_stream

    log = _log(spark)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = limited_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), "client", "ts", "request", cap=100)
    run = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    streamed = {(r.request, r.allowed, r.reason) for r in spark.table("limits").collect()}
    assert streamed == {(r.request, r.allowed, r.reason) for r in quota.limited_requests(log, "client", "ts", "request", cap=100).collect()}


def test_sources(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text('{"hadiths": [{"hadithnumber": 1, "text": "a"}, {"hadithnumber": 2, "text": null, "grades": [{"name": "n", "grade": "Sahih"}]}, {"hadithnumber": 1, "arabicnumber": 1.5, "text": "b"}]}')
    rows = {r.number: r for r in corpus.read_records(spark, str(path), "muslim").collect()}
    assert rows[1].text == "b" and rows[1].arabic_number == "1.5" and rows[2].text == "" and rows[2].grades[0].grade == "Sahih" and rows[2].book == 0
    assert corpus.read_verses(spark, str(tmp_path / "none.json")).count() == 0
    table = spark.createDataFrame([("a",), ("a",)], "collection string")
    assert corpus.check_counts(table, {"a": 2}).collect()[0].ok
    corpus.write_index(table, str(tmp_path / "index"), ["collection"])
    assert corpus.read_index(spark, str(tmp_path / "index")).count() == 2


def test_evaluation(spark):
    runs = spark.createDataFrame([("a", True, 5), ("a", True, 7), ("b", True, 1), ("b", False, 1)], "case string, passed boolean, duration int")
    assert {r["case"]: (r.consistent, r.passed) for r in evalkit.consistency(runs, "case").collect()} == {"a": (True, True), "b": (False, False)}
    values = spark.createDataFrame([("x", float(i)) for i in range(10)], "k string, v double")
    assert evalkit.floor_percentile(values, ["k"], "v", 0.95).first().p95 == 9.0
    graded = spark.createDataFrame([(1, "a", "sahih"), (1, "b", "daif"), (2, "a", "sahih"), (2, "a", "daif"), (3, "a", "sahih"), (3, "b", "neutral")], "k int, s string, f string")
    assert [r.k for r in evalkit.disagreements(graded, "k", "s", "f").collect()] == [1]
    assert evalkit.mutated_cases(spark.createDataFrame([(1, "one two three")], "k int, t string"), "k", "t").first().query != "one two three"
    posted = index.postings(spark.createDataFrame([(1, "الكتاب", "the book", None)], "doc_id int, arabic string, english string, commentary string"))
    assert {r.token for r in posted.collect()} == {"الكتاب", "كتاب", "the", "book"}


def test_envelopes_and_external(spark):
    from wordloom.plans.search import envelopes

    queries = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, ["x", "y", "z"])], "query_id int, words array<string>")
    matches = spark.createDataFrame([(1, 100, "matched"), (1, 89, "close_match"), (4, 75, "close_match")], "query_id int, confidence int, state string")
    found = {r.query_id: (r.state, r.top_confidence, r.total_matches, r.referral) for r in envelopes(queries, matches).collect()}
    assert found == {1: ("matched", 100, 2, False), 2: ("too_short", 0, 0, True), 3: ("not_found", 0, 0, True), 4: ("close_match", 75, 1, False)}
    items = spark.createDataFrame([(1, 7, 0, "abc", "xx abc", "t", "authentic"), (1, 8, 1, "abc", "zzz", "t", "weak")], "query_id int, id int, seq int, query string, text string, attribution string, grade string")
    rows = {r.record_id: (r.confidence, r.state, r.family) for r in corpus.external_records(items).collect()}
    assert rows == {"external_7": (100, "matched", "صحيح"), "external_8": (70, "close_match", "ضعيف")}
    cards = corpus.external_cards(items)
    assert retrieve.append_external(cards.where("seq = 0").drop("seq"), cards).count() == 2
