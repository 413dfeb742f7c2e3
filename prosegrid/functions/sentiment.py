"""Lexicon sentiment after the published rules (Hutto and Gilbert, 2014), with a small lexicon of our own.

``lexicon_compound`` is a JVM expression: summed valences, normalised. ``compound`` adds negation,
boosters, capitals, punctuation and ``but`` in an Arrow function.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function

# Valences of words from -4 to 4, our own choice.
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "boring": -1.3, "broken": -2.0, "brilliant": 2.8,
    "calm": 1.3, "clean": 1.7, "crash": -1.7, "disappointed": -2.1, "disgusting": -2.4, "easy": 1.9, "enjoy": 2.2, "excellent": 2.7,
    "fail": -2.5, "fantastic": 2.6, "fast": 0.9, "fine": 0.8, "free": 1.6, "fun": 2.3, "glad": 2.0, "good": 1.9, "great": 3.1,
    "happy": 2.7, "hate": -2.7, "helpful": 1.8, "horrible": -2.5, "love": 3.2, "lovely": 2.8, "mess": -1.5, "nice": 1.8, "perfect": 2.7,
    "poor": -2.1, "problem": -1.7, "sad": -2.1, "scam": -2.7, "slow": -0.9, "smart": 1.7, "stupid": -2.4, "terrible": -2.1, "thanks": 1.9,
    "ugly": -2.3, "useful": 1.9, "useless": -1.8, "waste": -1.8, "win": 2.8, "wonderful": 2.7, "worst": -3.1, "worse": -2.1, "wrong": -2.1,
}
BOOSTERS = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293}
NEGATIONS = {"not", "no", "never", "none", "nobody", "nothing", "neither", "cannot", "without", "hardly", "isn't", "don't", "doesn't", "didn't", "can't", "won't", "wasn't"}
ALPHA, CAPITALS, NEGATED = 15.0, 0.733, -0.74


def normalised(total: float) -> float:
    return max(-1.0, min(1.0, total / math.sqrt(total * total + ALPHA)))


def _valence(words: list[str], at: int, mixed: bool) -> float:
    value = LEXICON.get(words[at].lower(), 0.0)
    if not value:
        return 0.0
    sign = math.copysign(1.0, value)
    if mixed and words[at].isupper():
        value += sign * CAPITALS
    for distance, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        if at < distance or words[at - distance].lower() in LEXICON:
            continue
        near = words[at - distance].lower()
        value += sign * BOOSTERS.get(near, 0.0) * weight
        if near in NEGATIONS:
            value *= NEGATED
    return value


def compound(text: str | None) -> float:
    """The score of a text from -1 to 1 (0 for null and for texts without a known word)."""
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text or "")
    mixed = any(w.isupper() for w in words) and not all(w.isupper() for w in words)
    values = [_valence(words, at, mixed) for at in range(len(words))]
    lowered = [w.lower() for w in words]
    if "but" in lowered:
        turn = lowered.index("but")
        values = [v * (0.5 if at < turn else 1.5 if at > turn else 1.0) for at, v in enumerate(values)]
    total = sum(values)
    marks = min((text or "").count("!"), 4) * 0.292
    asked = (text or "").count("?")
    marks += 0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0.0
    return normalised(total + math.copysign(marks, total)) if total else 0.0


@arrow_function("double")
def compound_of(texts: pd.Series) -> pd.Series:
    return texts.map(compound).astype("float64")


def lexicon_compound(text: Column) -> Column:
    """Summed valences of the lower-cased ASCII words, normalised; no shuffle, no Python."""
    valences = F.create_map(*[F.lit(x) for pair in LEXICON.items() for x in pair])
    # A hash set leaves the few known words; only these are looked up in the map, which is searched in order.
    words = F.filter(F.split(F.lower(text), "[^a-z']+"), lambda w: w.isin(list(LEXICON)))
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + valences[w])
    # The array of one element gives the sum a name, so that it is computed once.
    return F.coalesce(F.get(F.transform(F.array(total), lambda s: s / F.sqrt(s * s + ALPHA)), F.lit(0)), F.lit(0.0))


def two_sided(score: Column) -> Column:
    """{positive, negative} of a compound score; a neutral score is wholly negative."""
    return F.when(score < 0, F.create_map(F.lit("negative"), -score, F.lit("positive"), 1 + score)).otherwise(F.create_map(F.lit("positive"), score, F.lit("negative"), 1 - score))
