"""Cleaning functions: Column -> Column over an array of tokens, evaluated in the JVM.

Each function takes and returns ``array<string>``; ``chain`` composes them. Those that need tables
that Spark lacks (stems, decompositions, free-form dates) are Arrow functions over the array.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function
from prosegrid.functions.stem import porter

Cleaner = Callable[[Column], Column]
_EDGES = r"(?U)^\s+|\s+$"


def chain(*steps: Cleaner) -> Cleaner:
    def run(tokens: Column) -> Column:
        for step in steps:
            tokens = step(tokens)
        return tokens

    return run


def _each(change: Callable[[Column], Column], drop_empty: bool) -> Cleaner:
    def run(tokens: Column) -> Column:
        out = F.transform(tokens, change)
        return F.filter(out, lambda t: t != "") if drop_empty else out

    return run


def lower_case() -> Cleaner:
    return _each(F.lower, False)


def white_space() -> Cleaner:
    """Strips Unicode white space and drops tokens that are empty then."""
    return _each(lambda t: F.regexp_replace(t, _EDGES, ""), True)


def punctuation() -> Cleaner:
    """Deletes ASCII punctuation and drops tokens that are empty then."""
    return _each(lambda t: F.translate(t, string.punctuation, ""), True)


def special_characters() -> Cleaner:
    """Deletes everything but ASCII letters and digits and drops tokens that are empty then."""
    return _each(lambda t: F.regexp_replace(t, "[^A-Za-z0-9]+", ""), True)


def stop_words(words: Iterable[str] | None = None, language: str = "english") -> Cleaner:
    """Drops exact matches, case-sensitively; without a list, Spark's list of the language is used."""
    if words is None:
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords(language)
    held = sorted(set(words))
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(held)) if held else tokens


def domain_keywords(pairs: Sequence[tuple[str, str]]) -> Cleaner:
    """Replaces keywords in the joined text, one pair after the other, and cuts at white space again."""

    def run(tokens: Column) -> Column:
        text = F.array_join(tokens, " ")
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")

    return run


def substitute(pattern: str | None, replacement: str | None) -> Cleaner:
    """Regular expression substitution in each token (Java dialect; ``\\1`` is accepted for ``$1``); None does nothing."""
    if not pattern or replacement is None:
        return lambda tokens: tokens
    java = re.sub(r"\\(\d)", r"$\1", replacement)
    return _each(lambda t: F.regexp_replace(t, pattern, java), False)


def ascii_tokens(tokens: Iterable[str | None]) -> list[str | None]:
    """Each token after compatibility decomposition, without what is not ASCII then."""
    return [t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in tokens]


@arrow_function("array<string>")
def _decode(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda row: None if row is None else ascii_tokens(row))


def decode_unicode() -> Cleaner:
    """Compatibility decomposition, then only ASCII is left; empty tokens stay."""
    return _decode


def _words(stem: Callable[[str], str]) -> Callable:
    @arrow_function("array<string>")
    def run(tokens: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(t: str) -> str:
            if t not in known:
                known[t] = stem(t)
            return known[t]

        return tokens.map(lambda row: None if row is None else [one(t) for t in row])

    return run


def stemming(stemmer: Callable[[str], str] | None = porter) -> Cleaner:
    """Stems each token (Porter unless another stemmer is given; None does nothing)."""
    return _words(stemmer) if stemmer else lambda tokens: tokens


def lemmatization(lemmatizer: Callable[[str], str]) -> Cleaner:
    """Replaces each token by its lemma; the lemmatizer is a plug-in, as no model is shipped."""
    return _words(lemmatizer)


@arrow_function("array<string>")
def _without_dates(tokens: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(row):
        if row is None or not len(row):
            return row
        text = " ".join(row)
        try:
            left = parser.parse(text, fuzzy_with_tokens=True)[1]
        except (ValueError, OverflowError, TypeError):
            return row
        return [t for part in left for t in part.split()]

    return tokens.map(one)


def date_time() -> Cleaner:
    """Drops what a free-form date parser reads as a date in the joined text; no date: unchanged."""
    return chain(_without_dates, white_space())


def default_chain(pairs: Sequence[tuple[str, str]] = (), stop: Iterable[str] | None = None, language: str = "english") -> Cleaner:
    """The standard order; stop words go after stemming."""
    return chain(
        lower_case(), white_space(), punctuation(), special_characters(), decode_unicode(), date_time(), domain_keywords(pairs), stemming(), stop_words(stop, language), white_space()
    )
