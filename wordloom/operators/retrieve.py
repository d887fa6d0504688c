"""Keyword evidence and verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.core import bound
from wordloom.functions.normalize import normalize_arabic, strip_prefix
from wordloom.functions.similarity import in_set
from wordloom.functions.tokens import content_tokens
from wordloom.operators.align import alignment
from wordloom.sources.staged import limited, written
from wordloom.vocab import retrieval

RARE_SHARE, LONG_TERM = 0.0075, 6
RARE, GENERIC, NORMAL, WEAK = 25.0, 1.0, 3.0, 0.1
DAMPED, COMMENTARY = 0.25, 0.5
CANDIDATES = 150
#: Terms of all questions that may be broadcast.
BROADCAST_TERMS = 500_000
LEAST_SCORE, PARTIAL, LEXICAL, ALIGNED = 15.0, 0.40, 0.70, 0.50
EVIDENCE_TOKENS, EVIDENCE_CARDS = 260, 5


def _plain(term: Column) -> Column:
    return F.lower(strip_prefix(normalize_arabic(term)))


def is_weak(term: Column, weak: list[str] = retrieval.WEAK_TERMS) -> Column:
    """Whether a term says little; null and empty do."""
    return (F.coalesce(term, F.lit("")) == "") | term.isin(weak) | _plain(term).isin(weak)


def is_rare(term: Column, df: Column, documents: Column, rare: list[str] = retrieval.RARE_TERMS, weak: list[str] = retrieval.WEAK_TERMS) -> Column:
    """Whether a term tells documents apart: listed, long, or in few documents (0.75 %); never a weak one."""
    few = F.coalesce(df <= documents * F.lit(RARE_SHARE), F.lit(False))
    return bound(_plain(term), lambda n: F.when(term.isin(rare) | n.isin(rare), True).when(is_weak(n, weak), False).when(F.length(n) >= LONG_TERM, True).otherwise(few))


def term_classes(terms: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """Adds df, rare, weak and weight to query_id, term."""
    # Terms are judged once each, however many queries share them.
    judged = terms.select("term").distinct().join(frequencies.withColumnRenamed("token", "term"), "term", "left")
    judged = judged.withColumn("rare", is_rare(F.col("term"), F.col("df"), F.lit(documents))).withColumn("weak", is_weak(F.col("term")))
    out = terms.join(judged, "term")
    weight = F.when(F.col("rare"), F.lit(RARE)).when(F.col("term").isin(retrieval.GENERIC_TERMS), F.lit(GENERIC)).when(~F.col("weak"), F.lit(NORMAL)).otherwise(F.lit(WEAK))
    return out.withColumn("weight", weight)


def keyword_hits(classes: DataFrame, postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, document, hits and rare: documents with two hits or a rare one, the best 150 a query."""
    # The classes are the questions' side; counted as few they go to the postings, whose documents then need no shuffle to be summed up.
    strong = limited(written(classes.where(~F.col("weak")).select("query_id", F.col("term").alias("token"), "rare"), "question-terms"), BROADCAST_TERMS)
    hits = postings.join(strong, "token")
    out = hits.groupBy("query_id", key).agg(F.count("*").alias("hits"), F.bool_or("rare").alias("rare")).where((F.col("hits") >= 2) | F.col("rare"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rare"), F.desc("hits"), key)
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)


def weighted_scores(found: DataFrame, classes: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores candidates by the terms that their text contains; ``documents`` has key, body, commentary and bonus.

    Commentary counts half; without a rare term or a bonus a score is cut to a
    quarter; two distinct terms that are not weak, a rare one or a bonus admit.
    """
    terms = classes.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight", "rare", "weak")).alias("terms"))
    # Few rows are much work here: they are dealt to all tasks.  Each text is searched once per term.
    spark = found.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = found.select("query_id", key).repartition(tasks, "query_id", key).join(documents, key).join(terms, "query_id")
    looked = F.transform("terms", lambda t: F.struct(t["weight"].alias("weight"), t["rare"].alias("rare"), t["weak"].alias("weak"), t["term"].alias("term"), F.contains(F.col("body"), t["term"]).alias("b"), F.coalesce(F.contains(F.col("commentary"), t["term"]), F.lit(False)).alias("c")))
    rows = rows.select("query_id", key, "bonus", looked.alias("looked")).select("query_id", key, "bonus", F.filter("looked", lambda t: t["b"] | t["c"]).alias("hits"))
    add = lambda side: F.aggregate(F.filter("hits", lambda t: t[side]), F.lit(0.0), lambda a, t: a + t["weight"])
    scored = rows.select(
        "query_id", key, "bonus", (add("b") + add("c") * COMMENTARY + F.col("bonus")).alias("raw"),
        F.exists("hits", lambda t: t["rare"]).alias("has_rare"), F.size(F.array_distinct(F.transform(F.filter("hits", lambda t: ~t["weak"]), lambda t: t["term"]))).alias("terms"),
    )
    plain = ~F.col("has_rare") & (F.col("bonus") == 0)
    scored = scored.withColumn("score", F.when(plain, F.col("raw") * DAMPED).otherwise(F.col("raw")))
    return scored.where((F.col("terms") >= 2) | F.col("has_rare") | (F.col("bonus") > 0)).drop("raw")


def two_group_top(scored: DataFrame, group: str, limits: dict[str, int], key: str = "doc_id") -> DataFrame:
    """The best few of each group of documents per query."""
    order = Window.partitionBy("query_id", group).orderBy(F.desc("score"), key)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.coalesce(F.try_element_at(limit, F.col(group)), F.lit(0)))


def relevance_gate(rows: DataFrame, most: int = 6, share: float = 0.60, key: str = "doc_id") -> DataFrame:
    """Cards that reach 60 % of the best score or share two concepts with the question, at most six."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    kept = rows.withColumn("top", top).where((F.col("score") >= share * F.col("top")) | (F.col("concepts") >= 2)).drop("top")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def concepts_shared(question: Column, terms: Column, document: Column, clusters: list[list[str]] = retrieval.CONCEPTS) -> Column:
    """How many concept clusters the question (or a term) and the document both touch."""
    asked, text = F.lower(normalize_arabic(question)), F.lower(normalize_arabic(document))
    total = F.lit(0)
    for cluster in clusters:
        words = F.array(*[F.lit(w) for w in cluster])
        in_question = F.exists(words, lambda w: F.contains(asked, w) | F.exists(terms, lambda t: F.contains(F.lower(t), w)))
        in_document = F.exists(words, lambda w: F.contains(text, F.lower(normalize_arabic(w))))
        total = total + (in_question & in_document).cast("int")
    return total


def pair_bonus(arabic: Column, english: Column, doc_id: Column) -> Column:
    """The bonus of a topic pair in one of the languages, and that of listed documents."""
    norm, lower = F.lower(normalize_arabic(arabic)), F.lower(english)
    has = lambda text, groups: F.lit(True) if not groups else has(text, groups[1:]) & F.exists(F.array(*[F.lit(w) for w in groups[0]]), lambda w: F.contains(text, w))
    pair = F.when(has(norm, retrieval.PAIR_ARABIC) | has(lower, retrieval.PAIR_ENGLISH), F.lit(35.0)).otherwise(F.lit(0.0))
    table = F.create_map(*[F.lit(x) for item in retrieval.DOCUMENT_BONUS.items() for x in item])
    return pair + F.coalesce(F.try_element_at(table, doc_id), F.lit(0.0))


def phrase_bonus(arabic: Column, english: Column) -> Column:
    """20 for each key phrase that the text of its language contains."""
    norm, lower = F.lower(normalize_arabic(arabic)), F.lower(english)
    latin = [p for p in retrieval.KEY_PHRASES if p.isascii()]
    other = [p for p in retrieval.KEY_PHRASES if not p.isascii()]
    count = lambda text, phrases, form: F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, form(p))))
    return F.lit(20.0) * (count(lower, latin, lambda p: p) + count(norm, other, lambda p: F.lower(normalize_arabic(p))))


def denied(question: Column) -> Column:
    """struct(saying, ruling) of the first denied saying that the question contains; null if none."""
    norm, lower = normalize_arabic(question), F.lower(question)
    out = F.lit(None).cast("struct<saying:string,ruling:string>")
    for keywords, saying, ruling in reversed(retrieval.DENIED):
        hit = F.lit(False)
        for word in keywords:
            hit = hit | (F.contains(lower, F.lit(word)) if word.isascii() else F.contains(norm, normalize_arabic(F.lit(word))))
        out = F.when(hit, F.struct(F.lit(saying).alias("saying"), F.lit(ruling).alias("ruling"))).otherwise(out)
    return out


def card_order(cards: Column) -> Column:
    """Sorts cards (struct score, has_phrase, is_verse, priority, prefix, number) by score, ties within 0.5 by the rest.

    As such ties are not transitive, the order of three or more close cards
    depends on the sort; it is that of Spark's ``array_sort``.
    """

    def compare(a: Column, b: Column) -> Column:
        down = lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)
        ties = [down(a["has_phrase"].cast("int"), b["has_phrase"].cast("int")), down(a["is_verse"].cast("int"), b["is_verse"].cast("int")), down(a["priority"], b["priority"]), down(b["prefix"], a["prefix"]), down(b["number"], a["number"])]
        tie = F.lit(0)
        for t in reversed(ties):
            tie = F.when(t != 0, t).otherwise(tie)
        return F.when(F.abs(a["score"] - b["score"]) > 0.5, down(a["score"], b["score"])).otherwise(tie)

    return F.array_sort(cards, compare)


def attestation(questions: DataFrame, cards: DataFrame, language: str) -> DataFrame:
    """query_id, lexical, aligned: the best single card's coverage of the question's content.

    ``questions`` has query_id and question; ``cards`` query_id, place and text.
    """
    asked = questions.select("query_id", content_tokens(F.col("question"), language).alias("asked"))
    rows = cards.where(F.col("place") <= EVIDENCE_CARDS).join(asked, "query_id").where(F.size("asked") > 0)
    rows = rows.withColumn("full", F.slice(content_tokens(F.col("text"), language, distinct=False), 1, EVIDENCE_TOKENS)).withColumn("set", content_tokens(F.col("text"), language))
    hits = F.size(F.filter("asked", lambda t: in_set(t, F.col("set")))) / F.size("asked")
    cover = lambda c: bound_cover(F.col("asked"), c)
    scored = rows.select("query_id", hits.alias("lexical"), F.greatest(cover(F.col("full")), cover(F.col("set"))).alias("aligned"))
    best = scored.groupBy("query_id").agg(F.max("lexical").alias("lexical"), F.max("aligned").alias("aligned"))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("aligned", F.lit(0.0)).alias("aligned"))


def bound_cover(asked: Column, source: Column) -> Column:
    a = alignment(asked, source)
    return (a["exact"] + a["near"]) / F.size(asked)


def verdict(cards: Column, top: Column, question: Column, lexical: Column, aligned: Column, ruling: Column | None = None) -> Column:
    """unclear, permissibility or supported, by score, kind of question and attestation."""
    norm = F.lower(normalize_arabic(question))
    asks = F.exists(F.array(*[F.lit(m) for m in retrieval.RULING_MARKS]), lambda m: F.contains(norm, m))
    asks = asks | ruling if ruling is not None else asks
    return (
        F.when((cards == 0) | (F.coalesce(top, F.lit(0.0)) < LEAST_SCORE), F.lit("unclear"))
        .when(asks, F.lit("permissibility"))
        .when(lexical < PARTIAL, F.lit("unclear"))
        .when((lexical < LEXICAL) | (aligned < ALIGNED), F.lit("permissibility"))
        .otherwise(F.lit("supported"))
    )


def append_external(cards: DataFrame, external: DataFrame, most: int = 2, score: float = 25.0) -> DataFrame:
    """Adds up to two external cards a query whose ids are new, with a fixed score."""
    fresh = external.join(cards.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("seq")
    picked = fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("score", F.lit(score))
    return cards.unionByName(picked.drop("rank", "seq"), allowMissingColumns=True)


def search(questions: DataFrame, terms_of: Callable[[DataFrame], DataFrame], expand: Callable[[DataFrame], DataFrame] | None, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two-step retrieval: local terms first, then, where given, expanded ones.

    ``run`` gives query_id, doc_id, place and score; a question's first results
    are replaced where the expanded search's first three documents differ.
    """
    first = run(terms_of(questions))
    if expand is None:
        return first
    second = run(expand(terms_of(questions)))
    heads = lambda df: df.where("place <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("head"))
    changed = heads(second).withColumnRenamed("head", "new").join(heads(first), "query_id", "left").where(~F.col("new").eqNullSafe(F.col("head"))).select("query_id")
    return first.join(changed, "query_id", "left_anti").unionByName(second.join(changed, "query_id", "left_semi"))
