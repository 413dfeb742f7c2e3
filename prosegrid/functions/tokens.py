"""Word and sentence tokenization as chains of regular expressions in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that a full stop does not end a sentence after.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "Inc", "Ltd", "Co", "No", "Fig", "e.g", "i.e", "U.S", "U.K", "a.m", "p.m"]
_NO_ABBREVIATION = "".join(rf"(?<!\b{a.replace('.', '[.]')})" for a in ABBREVIATIONS)
_CUT = "\u0001"

#: (pattern, replacement): each puts blanks around what is a token of its own.
_WORD_RULES = [
    (r"\.{3}", " \u2026 "),  # an ellipsis stays whole
    (r"([\u2018\u2019\u201c\u201d\u00ab\u00bb])", " $1 "),
    (r"(?<!\S)\"|\"", ' " '),
    (r"([;@#$%&?!\[\](){}<>*])", " $1 "),
    (r"--", " -- "),
    (r"([:,])(?=\D|$)", " $1 "),
    (rf"(?<=[^\s.]){_NO_ABBREVIATION}\.(?=[\])}}>\"']*\s*$)", " . "),
    (rf"(?<=[^\s.]){_NO_ABBREVIATION}\.(?=\s+[\"'(]*\p{{Lu}})", " . "),
    (r"(?i)(?<=\w)('s|'m|'d|'ll|'re|'ve|n't)\b", " $1"),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?<=[^'\s])'(?=\s|$)|(?<=\s|^)'(?=\S)", " ' "),
    (r"\u2026", "..."),
]


def white_space_tokens(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Treebank-style tokens: punctuation and clitics are tokens, sentence-final full stops are cut off."""
    for pattern, new in _WORD_RULES:
        text = F.regexp_replace(text, pattern, new)
    return white_space_tokens(text)


def sentences(text: Column) -> Column:
    """Sentences without the white space between them: cut after ``.!?`` and closing marks before a capital or digit."""
    end = "".join([r"(?<=[.!?])(?<!\b[A-Z][.])", *[rf"(?<!\b{a.replace('.', '[.]')}[.])" for a in ABBREVIATIONS]])
    marked = F.regexp_replace(text, end + r"([\"'\u2019\u201d)\]]*)\s+(?=[\"'\u2018\u201c(\[]*[\p{Lu}\p{N}])", f"$1{_CUT}")
    return F.filter(F.transform(F.split(marked, _CUT), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def tokens(text: Column, tokenizer: Callable[[Column], Column] | None) -> Column:
    """Tokens of a text; without a tokenizer the whole text is one token."""
    return tokenizer(text) if tokenizer else F.array(text)
