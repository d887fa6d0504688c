"""Tokens and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.core import bound, ngrams, words
from wordloom.functions.normalize import fold_for_index, line_breaks, normalize_arabic, strip_prefix
from wordloom.vocab import arabic as vocab
from wordloom.vocab import retrieval


def is_punctuation(word: Column) -> Column:
    """Whether nothing is left of a word once normalised."""
    return F.translate(normalize_arabic(word), "‎‏", "") == ""


def display_tokens(text: Column) -> Column:
    """The words as printed: array of struct(word, normalized, place, skip); punctuation and honorifics are skipped."""

    def of(shown: Column) -> Column:
        plain = F.transform(shown, lambda w: F.translate(normalize_arabic(w), "‎‏", ""))

        def mark(norms: Column) -> Column:
            def covered(i: Column) -> Column:
                hit = F.lit(False)
                for sequence in vocab.SKIPPED:
                    for back in range(len(sequence)):
                        starts = [F.get(norms, i - back + k).isin(options) for k, options in enumerate(sequence)]
                        here = F.coalesce(i >= back, F.lit(False))
                        for s in starts:
                            here = here & F.coalesce(s, F.lit(False))
                        hit = hit | here
                return hit

            return F.transform(shown, lambda w, i: F.struct(w.alias("word"), F.get(norms, i).alias("normalized"), i.alias("place"), ((F.get(norms, i) == "") | covered(i)).alias("skip")))

        return bound(plain, mark)

    return bound(words(line_breaks(F.coalesce(text, F.lit("")))), of)


def kept_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t["skip"])


def strip_chain_tokens(tokens: Column) -> Column:
    """Display tokens after the chain of narrators; all of them where no chain is found."""

    def of(t: Column) -> Column:
        n = F.size(t)
        last = F.greatest(F.floor(n * F.lit(0.9)).cast("int"), n - 2)

        def after(i: Column) -> Column:
            tried = []
            for m in vocab.ATTRIBUTIONS:
                here = F.lit(True)
                for k, word in enumerate(m):
                    here = here & F.coalesce(F.get(t, i + k)["normalized"] == word, F.lit(False))
                end = F.when(F.get(t, i + len(m))["normalized"].isin(vocab.SAID), i + len(m) + 1).otherwise(i + len(m))
                tried.append(F.when(here & (end < n), end))
            return F.coalesce(*tried)

        ends = F.filter(F.transform(F.sequence(F.lit(0), last), after), lambda e: e.isNotNull())
        return bound(F.when(n > 4, F.get(ends, F.lit(0))), lambda e: F.when(e.isNull(), t).otherwise(F.slice(t, F.coalesce(e, F.lit(0)) + 1, n)))

    return bound(tokens, of)


def index_tokens(arabic: Column, english: Column, commentary: Column | None = None) -> Column:
    """The distinct tokens a document is indexed under."""

    def folded(text: Column) -> Column:
        parts = F.filter(F.split(fold_for_index(text), "[^ء-ي]+"), lambda w: F.length(w) >= 2)
        return bound(parts, lambda p: F.concat(p, F.filter(F.transform(p, strip_prefix), lambda w: F.length(w) >= 2)))

    latin = F.filter(F.split(F.lower(F.coalesce(english, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    every = [folded(arabic), *([folded(commentary)] if commentary is not None else []), latin]
    return F.array_distinct(F.concat(*every))


def local_terms(question: Column) -> Column:
    """A question's search terms without a model: words that are no stop words, or else the question itself."""
    parts = F.filter(F.split(F.lower(normalize_arabic(question)), "[^؀-ۿa-z0-9]+"), lambda w: F.length(w) >= 2)
    kept = F.filter(parts, lambda w: ~w.isin(retrieval.STOP_WORDS))
    return bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(question)))


def content_tokens(text: Column, language: str, distinct: bool = True) -> Column:
    """Words of two letters or more that are not question frame, before and after prefixes go."""
    base = F.lower(F.coalesce(text, F.lit(""))) if language == "en" else F.lower(normalize_arabic(text))
    keep = lambda w: (F.length(w) >= 2) & ~w.isin(retrieval.FRAME_TERMS)
    parts = F.filter(F.split(base, r"[^\p{L}\p{N}]+"), keep)
    if language != "en":
        parts = F.filter(F.transform(parts, strip_prefix), keep)
    return F.array_distinct(parts) if distinct else parts


def expand_terms(terms: Column) -> Column:
    """Adds the words of terms that have several, and the terms that go with certain topics."""
    split = F.flatten(F.transform(terms, lambda t: bound(F.filter(words(t), lambda w: F.length(w) >= 2), lambda p: F.when(F.size(p) > 1, F.concat(F.array(t), p)).otherwise(F.array(t)))))

    def of(t: Column) -> Column:
        added = []
        for triggers, more in retrieval.EXPANSIONS:
            pattern = "|".join(triggers)
            hit = F.exists(t, lambda x: F.lower(x).rlike(pattern))  # noqa: B023
            added.append(F.when(hit, F.array(*[F.lit(m) for m in more])).otherwise(F.array().cast("array<string>")))
        return F.concat(t, *added)

    return bound(F.filter(split, lambda t: t != ""), of)


def split_by_script(terms: Column) -> tuple[Column, Column]:
    """Distinct Arabic terms, normalised and without prefixes, and distinct Latin ones in lower case."""
    latin = lambda t: t.rlike("(?i)^[a-z]")
    arabic = F.filter(F.transform(terms, lambda t: strip_prefix(normalize_arabic(t))), lambda t: (F.length(t) >= 2) & ~latin(t))
    english = F.filter(F.transform(terms, lambda t: F.trim(F.lower(t))), lambda t: (F.length(t) >= 2) & latin(t))
    return F.array_distinct(arabic), F.array_distinct(english)


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours, as two words with a space."""
    return F.array_distinct(F.transform(ngrams(tokens, 2), lambda p: F.array_join(p, " ")))


def phrases(tokens: Column, least: int = 4, most: int = 8) -> Column:
    """All runs of ``least`` to ``most`` tokens, joined by spaces."""
    return F.flatten(F.array(*[F.transform(ngrams(tokens, n), lambda p: F.array_join(p, " ")) for n in range(least, most + 1)]))
