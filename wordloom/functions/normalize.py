"""Text normalisation for matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.core import SPACE, bound, collapse, replace, words
from wordloom.vocab import arabic as vocab

_MARKS = r"ً-ٟۖ-ۭ࣓-ࣿ"
_DAGGER = r"ٰ"
_WAW_MARKS = rf"[{_MARKS}]*"
_INVISIBLE = r"​‌‍⁠﻿"
_EDGE = r"[\s،.؛!؟()\[\]«»]"


def clean_marks(text: Column) -> Column:
    """Joins combining marks to their letters: white space before them goes; other no-break spaces become spaces."""
    joined = replace(text, rf"[{SPACE}{_INVISIBLE}]+(?=[{_MARKS}{_DAGGER}])", "")
    return F.translate(joined, " ", " ")


def fold_silent_waw(text: Column) -> Column:
    """A waw that carries an alef's sound becomes alef."""
    s = replace(text, rf"و{_WAW_MARKS}{_DAGGER}(?=[{_MARKS}]*[ةا])", "ا")
    stems = "|".join(vocab.WAW_STEMS)
    s = replace(s, rf"([وفبلك]*(?:ال)?)({stems})و(ة)(?={_EDGE}|\z)", "$1$2ا$3")
    return replace(s, rf"(^|{_EDGE})([وفبلك]*(?:ال)?)ربوا(?={_EDGE}|\z)", "$1$2ربا")


def _daggers(text: Column) -> Column:
    yeh, tail = r"[ىيی]", r"[ً-ٟۖ-ۭـ]*"
    s = replace(text, rf"(^|[{SPACE}]){yeh}{tail}{_DAGGER}{tail}(?=[ء-يٱ-ۓ])", "$1يا ")
    s = replace(s, rf"{yeh}{_WAW_MARKS}{_DAGGER}(?={_WAW_MARKS}[ء-يٱ-ۓۥۦ])", "ا")
    s = replace(s, rf"{yeh}{_WAW_MARKS}{_DAGGER}", "ي")
    return F.translate(s, "ٰ", "ا")


def _letters(text: Column) -> Column:
    s = replace(text, rf"[{_INVISIBLE}ـ{_MARKS}]", "")
    s = F.replace(s, F.lit("ءا"), F.lit("ا"))
    return F.translate(s, "آأإٱةىیؤئٴ", "ااااهييءءء")


def normalize_arabic(text: Column) -> Column:
    """The form that quotations are matched in; null and empty are empty.

    Spelling variants are folded, marks, digits and punctuation go, some words
    are rewritten, and some pairs of words are merged.  Latin case stays.
    """
    s = F.translate(clean_marks(F.coalesce(text, F.lit(""))), "\u06a9\u0649\u06cc", "كيي")
    s = _letters(_daggers(fold_silent_waw(s)))
    s = replace(s, vocab.PUNCTUATION, " ")
    table = F.create_map(*[F.lit(x) for pair in vocab.REWRITES.items() for x in pair])
    s = F.array_join(F.transform(words(s), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    for first, second, merged in vocab.MERGES:
        s = replace(s, rf"(^| ){first} {second}(?= |\z)", f"$1{merged}")
    return s


def alef_invariant(normalized: Column) -> Column:
    """Normalised text without alef and hamza, which spellings differ in most."""
    return collapse(F.translate(normalized, "ا\u0670ء", ""))


def normalize_english(text: Column) -> Column:
    """Lower case; parenthesised text goes; quotes and hyphens join; the rest but a-z and 0-9 is space."""
    s = replace(F.lower(F.coalesce(text, F.lit(""))), r"\([^)]*\)", " ")
    s = replace(F.translate(s, "()", "  "), "['\"’`\\-–]", "")
    return F.trim(replace(s, "[^a-z0-9]+", " "))


def strip_formulas(normalized: Column) -> Column:
    """Without honorifics and source notes, each tried in order."""
    phrases = [*vocab.FORMULAS, rf"(?:{'|'.join(vocab.REPORTED)}) (?:{'|'.join(vocab.REPORTERS)})", vocab.AGREED]
    return collapse(reduce(lambda s, p: replace(s, p, " "), phrases, F.coalesce(normalized, F.lit(""))))


def strip_chain(normalized: Column) -> Column:
    """Splits a record at the end of its chain of narrators: struct(matn, stripped, ratio, offset).

    The chain ends at the first attribution within 90 % of the words, an
    honorific and "said" after it included; it stays where four words or fewer
    are given or none would be left.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.floor(n * F.lit(0.9)).cast("int"), n - 2)

        def after(i: Column) -> Column:
            """Words up to the body if an attribution starts at word i, else null."""
            ends = [F.when(F.array_join(F.slice(w, i + 1, len(m)), " ") == " ".join(m), i + len(m)) for m in vocab.ATTRIBUTIONS]

            def past(end: Column) -> Column:
                honoured = F.when(F.array_join(F.slice(w, end + 1, 4), " ").isin(vocab.HONORIFIC), end + 4).otherwise(end)
                return bound(honoured, lambda e: F.when(F.get(w, e).isin(vocab.SAID), e + 1).otherwise(e))

            # Attributions are tried in order; one that leaves no body does not count.
            tried = [F.when(end.isNotNull(), bound(past(end), lambda e: F.when(e < n, e))) for end in ends]
            return F.coalesce(*tried)

        found = F.filter(F.transform(F.sequence(F.lit(0), last), after), lambda e: e.isNotNull())
        offset = F.when(n > 4, F.get(found, F.lit(0)))
        return bound(F.coalesce(offset, F.lit(0)), lambda o: F.struct(
            F.when(o > 0, F.array_join(F.slice(w, o + 1, F.greatest(n - o, F.lit(0))), " ")).otherwise(normalized).alias("matn"),
            (o > 0).alias("stripped"),
            F.when(o > 0, F.floor(o.cast("double") / n * 100 + 0.5) / 100).otherwise(F.lit(0.0)).cast("double").alias("ratio"),
            o.cast("int").alias("offset"),
        ))

    return bound(words(normalized), of)


def strip_tags(text: Column) -> Column:
    """Mark-up tags become spaces; an unclosed one stays."""
    return replace(text, "<[^>]*>", " ")


def strip_open_tags(text: Column) -> Column:
    """Mark-up tags go, an unclosed one too."""
    return replace(text, "<[^>]*>?", "")


def line_breaks(text: Column) -> Column:
    return replace(text, r"(?i)<br\s*/?>", " ")


def strip_section_marks(text: Column) -> Column:
    """Without the decorative section signs of printed editions."""
    return collapse(replace(text, r"[۞۩﴾﴿]", " "))


def strip_marks(text: Column) -> Column:
    """Without any mark, ornament or stretched line, for typed variants of a text."""
    return collapse(replace(text, r"[ً-ٰٟۖ-ۭؐ-ؚࣔ-ࣲ﴾﴿ـ]", ""))


def clean_matn(text: Column, limit: int = 80) -> Column:
    """A record's body: without tags, cut after the first listed marker found before 65 % of it, ``limit`` words."""

    def of(s: Column) -> Column:
        cut = F.lit(None).cast("string")
        for marker in reversed(vocab.BODY_MARKERS):
            place = F.locate(marker, s)
            cut = F.when((place > 0) & ((place - 1) < F.length(s) * F.lit(0.65)), F.substring(s, place + len(marker), F.length(s))).otherwise(cut)
        return F.array_join(F.slice(words(F.coalesce(cut, s)), 1, limit), " ")

    return bound(strip_tags(F.coalesce(text, F.lit(""))), of)


def fold_for_index(text: Column) -> Column:
    """The weaker folding that the search index is built with."""
    return F.translate(replace(F.coalesce(text, F.lit("")), r"[ً-ٰٟ]", ""), "آأإٱىة", "اااايه")


def strip_prefix(word: Column) -> Column:
    """Takes one light prefix off a normalised word; not idempotent."""

    def of(w: Column) -> Column:
        out = w
        for prefix in reversed(vocab.SHORT_PREFIXES):
            out = F.when(w.startswith(prefix) & (F.length(w) > 3), F.substring(w, F.lit(2), F.length(w))).otherwise(out)
        for prefix, least in reversed(vocab.LONG_PREFIXES):
            out = F.when(w.startswith(prefix) & (F.length(w) > least), F.substring(w, F.lit(len(prefix) + 1), F.length(w))).otherwise(out)
        return out

    return bound(word, of)


def is_latin_only(text: Column) -> Column:
    return text.rlike("[a-zA-Z]") & ~text.rlike(r"[؀-ۿ]")


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


def cache_key(text: Column) -> Column:
    return collapse(F.lower(normalize_arabic(text)))


def join_translations(parts: Column) -> Column:
    """Joins verses' translations; of several, those without end punctuation get a comma, the last a full stop; an odd quote is closed."""
    n = F.size(parts)

    def ended(part: Column, i: Column) -> Column:
        def close(clean: Column) -> Column:
            bare = (n > 1) & (clean != "") & ~clean.rlike(r"[.!?,:;\-—\"')\]]\z")
            return F.concat(clean, F.when(bare, F.when(i < n - 1, F.lit(",")).otherwise(F.lit("."))).otherwise(F.lit("")))

        return bound(collapse_ends(part), close)

    joined = F.array_join(F.filter(F.transform(parts, ended), lambda p: p != ""), " ")
    odd = lambda s: (F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))) % 2 == 1
    return bound(joined, lambda s: F.when(odd(s), F.concat(s, F.lit('"'))).otherwise(s))


def collapse_ends(text: Column) -> Column:
    """Without white space at the ends."""
    return replace(replace(text, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")
