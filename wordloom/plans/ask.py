"""Questions answered by keyword evidence, batched over questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.normalize import normalize_arabic
from wordloom.functions.tokens import expand_terms, local_terms, split_by_script
from wordloom.operators import index, retrieve
from wordloom.sources.staged import written

#: Cards of each type that are ranked, and the collections' precedence.
CARDS = {"ayah": 2, "hadith": 4}
PRECEDENCE = {"ayah": 10, "bukhari": 9, "muslim": 8, "abudawud": 7, "tirmidhi": 6, "nasai": 5, "ibnmajah": 4, "nawawi": 3}


def question_terms(questions: DataFrame) -> DataFrame:
    """query_id and term: a question's words, those that go with its topics, in both scripts; ``terms`` replaces the words where it is given."""
    own = local_terms(F.col("question"))
    given = F.coalesce(F.col("terms"), own) if "terms" in questions.columns else own
    rows = questions.select("query_id", expand_terms(given).alias("raw"))
    arabic, latin = split_by_script(F.col("raw"))
    return rows.select("query_id", F.explode(F.array_distinct(F.concat(arabic, latin))).alias("term"))


def _text(language: str) -> Column:
    """A document's text in the question's language, else in the other."""
    order = ("english", "arabic") if language == "en" else ("arabic", "english")
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in order], F.lit(""))


def _natural(doc_id: Column) -> Column:
    """An id whose numbers sort as numbers."""
    return F.array_join(F.transform(F.split(doc_id, "_"), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 12, "0")).otherwise(x)), "_")


def keyword_cards(questions: DataFrame, documents: DataFrame, language: str) -> DataFrame:
    """The evidence of each question: query_id, doc_id, doc_type, score, concepts, text, place; six cards at most.

    ``questions`` has query_id and question; ``documents`` doc_id, doc_type
    (ayah or hadith), arabic, english and commentary.  Documents with two of the
    terms or a rare one are scored by terms, topics and key phrases; the best of
    each type are ordered, with close scores by phrase, type, precedence and id,
    and stay if they reach 60 % of the first or share two concepts.
    """
    terms = written(question_terms(questions), "ask-terms")
    posted = written(index.postings(documents).join(terms.select(F.col("term").alias("token")).distinct(), "token", "left_semi"), "ask-postings")
    classes = written(retrieve.term_classes(terms, index.document_frequencies(posted), documents.count()), "ask-classes")
    hits = written(retrieve.keyword_hits(classes, posted), "ask-hits")
    # Bonuses are worked out for candidates alone.
    met = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    arabic, english = F.coalesce("arabic", F.lit("")), F.coalesce("english", F.lit(""))
    searched = met.select(
        "doc_id", F.concat_ws("\n", F.lower(normalize_arabic(arabic)), F.lower(english)).alias("body"), F.lower(normalize_arabic(F.coalesce("commentary", F.lit("")))).alias("commentary"),
        (retrieve.pair_bonus(arabic, english, F.col("doc_id")) + retrieve.phrase_bonus(arabic, english)).alias("bonus"),
    )
    scored = retrieve.weighted_scores(hits, classes, written(searched, "ask-searched")).join(met.select("doc_id", "doc_type"), "doc_id")
    top = retrieve.two_group_top(scored, "doc_type", CARDS).select("query_id", "doc_id", "score")
    asked = questions.select("query_id", "question").join(terms.groupBy("query_id").agg(F.collect_list("term").alias("terms")), "query_id")
    rows = top.join(met, "doc_id").join(asked, "query_id").withColumn("text", _text(language))
    phrase = F.contains(F.lower(normalize_arabic(F.col("text"))), F.lower(normalize_arabic(F.col("question"))))
    known = F.create_map(*[F.lit(x) for pair in PRECEDENCE.items() for x in pair])
    card = F.struct(
        "score", phrase.alias("has_phrase"), (F.col("doc_type") == "ayah").alias("is_verse"), F.coalesce(F.try_element_at(known, F.substring_index("doc_id", "_", 1)), F.lit(1)).alias("priority"),
        _natural(F.col("doc_id")).alias("prefix"), F.lit(0).alias("number"), "doc_id", "doc_type", "text",
        retrieve.concepts_shared(F.col("question"), F.col("terms"), F.concat_ws(" ", "arabic", "english")).alias("concepts"),
    )
    # Six cards a question are gathered, no more.
    sorted_ = rows.select("query_id", card.alias("c")).groupBy("query_id").agg(retrieve.card_order(F.collect_list("c")).alias("cards"))
    passed = F.filter("cards", lambda c: (c["score"] >= 0.60 * F.get("cards", F.lit(0))["score"]) | (c["concepts"] >= 2))
    out = sorted_.select("query_id", F.posexplode(F.slice(passed, 1, 6)).alias("place", "c"))
    return out.select("query_id", "c.doc_id", "c.doc_type", "c.score", "c.concepts", "c.text", (F.col("place") + 1).alias("place"))


def answers(questions: DataFrame, documents: DataFrame, language: str) -> DataFrame:
    """One row per question: verdict, its evidence and how well that attests the question.

    A denied saying is contradicted and is not searched for; null and blank
    questions are unclear.  ``cards`` has the ids of the evidence in order.
    """
    named = questions.withColumn("question", F.trim(F.coalesce("question", F.lit("")))).withColumn("denied", retrieve.denied(F.col("question")))
    named = written(named, "ask-questions")
    asked = named.where("denied is null and question <> ''")
    cards = written(keyword_cards(asked, documents, language), "ask-cards")
    attested = retrieve.attestation(asked, cards, language)
    best = cards.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda c: c["doc_id"]).alias("cards"))
    rows = named.join(best, "query_id", "left").join(attested, "query_id", "left")
    n, zero = F.coalesce("n", F.lit(0)), F.lit(0.0)
    judged = retrieve.verdict(n, F.col("top"), F.col("question"), F.coalesce("lexical", zero), F.coalesce("aligned", zero))
    verdict = F.when(F.col("denied").isNotNull(), F.lit("contradicted")).otherwise(judged)
    return rows.select(
        "query_id", verdict.alias("verdict"), n.cast("int").alias("retrieved"), F.coalesce("top", zero).alias("top"), F.coalesce("lexical", zero).alias("lexical"), F.coalesce("aligned", zero).alias("aligned"),
        F.col("denied.saying").alias("saying"), F.col("denied.ruling").alias("ruling"), F.coalesce("cards", F.array().cast("array<string>")).alias("cards"),
    )
