"""URL filters: listed rules, then association rules mined by FP-growth.

A URL becomes a set of tokens (scheme, host suffixes, path words, extension,
query keys).  FP-growth mines the frequent combinations of tokens and the label
among labelled URLs; rules "tokens -> block" that reach the least support and
confidence stay, but for those that a shorter rule makes needless.  An inverted
index from each rule's rarest token finds the rules that may fit a URL; a rule
fits if the URL has all its tokens.

Listed rules (host, path, verdict) come first: one fits its host and all
subdomains, if the URL's path begins with its path; the longest wins.

Scale: only urls are read, never pages; equal token sets are judged once; the
rules are broadcast if their counted number allows it and else joined by token.
Mining takes whole token sets, exactly: tokens below the least support are in no
rule, and tokens that occur in the very same labelled URLs are mined as one and
stand for each other in the rules.  What remains grows with the number of
combinations of frequent tokens that differ.

Defined results: a null url, or one without "://", has an empty host and path and
no tokens, so that only the default verdict "allow" is left; rows are judged one
by one; labels that share a doc_id count as blocked if any is; without labelled
URLs there are no mined rules; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.store import limited, written

#: The listed rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SUPPORT = 0.002
CONFIDENCE = 0.6
#: Labelled URLs that a rule needs at least, however few there are.
LEAST_URLS = 10
BLOCK = "label:block"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without "://"."""
    place = F.locate("://", url)
    rest = F.substring(url, place + 3, F.length(url))
    has = F.coalesce(place > 0, F.lit(False))
    host = F.when(has, _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(F.lit(""))
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def tokens(url: Column) -> Column:
    """The URL's distinct tokens, sorted: what they are, then the value; long numbers are one value."""
    host, path = parts(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path:"), F.regexp_replace(w, r"^\p{N}+$", "0")))
    extension = F.concat(F.lit("ext:"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("query:"), F.lower(F.regexp_extract(p, r"^([^=]*)", 1))))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([^:]*)", 1))))
    found = F.sort_array(F.array_distinct(F.concat(scheme, suffixes, words, F.array(extension), keys)))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def mined_rules(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules "antecedent -> block" from columns tokens and blocked: antecedent, anchor, confidence, support.

    The antecedent is a list of groups of tokens; it needs one token of each.
    """
    spark = urls.sparkSession
    known = urls.where("blocked is not null and size(tokens) > 0").select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id())
    known = written(known, "url-known")
    empty = spark.createDataFrame([], "antecedent array<array<string>>, anchor array<string>, confidence double, support double")
    n = known.count()
    if n < LEAST_URLS:
        return empty
    least = max(LEAST_URLS, ceil(support * n))
    # Tokens of the same rows: as many, with equal 128-bit hashes of the rows.
    rows = known.select("row", F.explode("tokens").alias("token"))
    same = rows.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("_x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_y")).where(F.col("freq") >= least)
    groups = written(same.groupBy("freq", "_x", "_y").agg(F.sort_array(F.collect_list("token")).alias("members")).select("freq", "members", F.col("members")[0].alias("token")), "url-groups")
    baskets = rows.join(limited(groups.select("token"), 100_000), "token").groupBy("row").agg(F.collect_list("token").alias("items")).join(known.select("row", "blocked"), "row")
    baskets = written(baskets.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "url-baskets")
    filled = baskets.count()
    if not filled:
        return empty
    # Support is counted in all labelled URLs, also those without a frequent token.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / filled, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK).select(F.sort_array("antecedent").alias("antecedent"), "confidence")
    rules = written(rules, "url-rules")
    # A rule is needless if one token less gives a rule too.
    shorter = rules.select(F.col("antecedent").alias("_less")).distinct()
    longer = rules.select("antecedent", F.explode(F.transform("antecedent", lambda t: F.array_remove(F.col("antecedent"), t))).alias("_less")).join(shorter, "_less", "left_semi").select("antecedent").distinct()
    rules = rules.join(longer, "antecedent", "left_anti")
    ranked = rules.select(F.col("antecedent").alias("_rule"), "confidence", F.explode("antecedent").alias("token")).join(groups, "token").groupBy("_rule", "confidence")
    out = ranked.agg(F.collect_list("members").alias("antecedent"), F.min_by("members", F.struct("freq", "token")).alias("anchor"))
    counts = model.freqItemsets.where(F.array_contains("items", BLOCK)).select(F.sort_array(F.array_remove("items", BLOCK)).alias("_rule"), (F.col("freq") / n).alias("support"))
    return out.join(counts, "_rule").select(*empty.columns)


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets that some rule fits, with the best rule's confidence, by the inverted index."""
    index = rules.select(F.explode("anchor").alias("token"), "antecedent", "confidence")
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.forall("antecedent", lambda g: F.arrays_overlap(g, F.col("tokens")))).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as written ("net/"), and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filtered(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the mined rules' confidence (null if none fits).

    ``labels`` has doc_id and blocked.
    """
    urls = pages.select("page_id", "url", tokens(F.col("url")).alias("tokens"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("blocked").alias("blocked"))
    found = written(mined_rules(urls.join(marks, "page_id").select("tokens", "blocked"), support, confidence), "url-index")
    hits = written(matched(urls.select("tokens").distinct(), limited(found, 100_000)), "url-hits")
    host, path = parts(F.col("url"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    # URLs without tokens have one key in common and take no part in the join.
    bare = urls.where("size(tokens) = 0").withColumn("confidence", F.lit(None).cast("double"))
    judged = urls.where("size(tokens) > 0").join(hits, "tokens", "left").unionByName(bare).select("page_id", host.alias("host"), path.alias("path"), "confidence")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.col("confidence").alias("mined_confidence"))
