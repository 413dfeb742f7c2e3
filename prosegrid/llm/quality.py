"""Quality rules with adaptive thresholds instead of fixed cutoffs.

Every document gets base counts (words, symbols, repeated lines, repeated three-word windows) and
from them four ratios. Per language and source the ratios of the documents that pass the base
rule go into mergeable quantile sketches of relative error (logarithmic buckets; merging is the
sum of the bucket counts, so the result is the same in any order and on any number of machines).
From each sketch come the quantiles ``MIDDLE`` and ``UPPER`` (and ``LOWER``); the threshold is the
upper one plus ``REACH`` times its distance to the middle, and the mirror image below where a ratio can be
too small. Nothing else enters: a source with a narrow spread has narrow thresholds.

Small groups: the quantiles of a source are averaged with those of its language, those of a
language with those over everything, with the weights n and ``PRIOR`` rows; there is no number of
rows at which one rule takes over from another.

Short texts: a count k over n is judged by its excess over limit * n in standard errors: it is too
high if k > limit * n + ``ERRORS`` * sqrt(limit * n + 1), so that a symbol or two, or one repeated line, condemn
no text, whatever its length.

Words: ``[^\\x20\\x09-\\x0D]+`` of whole texts, of any length.

Defined cases: null and empty texts have no words and fail the base rule; null languages and
sources are groups of their own; a group without a document that passes takes its language's
thresholds, and if no document passes nothing is kept; an empty table gives no rows; repeated rows
count each; columns named like an output column are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, scope, stored, utf8, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios, as (count, over); the mean length of a word is no share and has a lower threshold too.
RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
BOTH_SIDES = ("word_length",)
LOWER, MIDDLE, UPPER = 0.15, 0.5, 0.85
REACH = 16.0
ERRORS = 3.0
PRIOR = 200  # rows of the wider group that join each group
BROADCAST_GROUPS = 200_000  # rows of about 100 bytes
SALTS = 32
ACCURACY = 0.01  # relative error of a quantile
_LEAST = 1e-4  # values below are one bucket
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds at least twice (all of their places)."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(own[:-1] * len(number) + own[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(number) + own[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(hit) - 2 + k] |= again
    return int(hit.sum())


def counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """BASE and the number of lines with a word, of a whole text in UTF-8."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    code = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((code & 0xC0) != 0x80))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def base_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with BASE and n_lines in the place of the text column."""
    added = [*BASE, "n_lines"]
    docs = without(docs, added)
    rest = [c for c in docs.columns if c != text]
    sent = docs.select(*[f"`{c}`" for c in rest], utf8(text).alias("__text"))
    schema = extended(sent, rest, ", ".join(f"{n} long" for n in added))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([counts(t.as_py()) for t in batch.column(len(rest))], np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(found[:, k]) for k in range(len(added))]], names=[*rest, *added])

    return arrow_map(sent, make, schema)


def ratios() -> dict[str, Column]:
    """The ratios that thresholds are set for."""
    return {name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in RATIOS.items()}


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value of 0 or more."""
    return F.when(value < _LEAST, F.lit(None)).otherwise(F.ceil(F.log(value) / F.log(F.lit(_GAMMA)))).cast("int")


def bucket_value(number: Column) -> Column:
    """The value that stands for a bucket, within ACCURACY of all values in it."""
    return F.coalesce(2 * F.pow(F.lit(_GAMMA), number) / (F.lit(_GAMMA) + 1), F.lit(0.0))


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: (by, feature, bucket, n); sketches are merged by summing n."""
    features = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(F.col(k)).alias("bucket")) for k in RATIOS])).alias("f")
    return measured.select(*by, features).groupBy(*by, "f.feature", "f.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, rows, lower, middle, upper) of each sketch."""
    keys = [*by, "feature"]
    up = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketch.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*keys))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.struct("upto", bucket_value(F.col("bucket")).alias("v"))))["v"]
    return ranked.groupBy(*keys).agg(F.max("total").alias("rows"), at(LOWER).alias("lower"), at(MIDDLE).alias("middle"), at(UPPER).alias("upper"))


def blended(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """The quantiles of ``own`` averaged with PRIOR rows of those of the wider group that it belongs to."""
    parts = ("lower", "middle", "upper")
    above = wider.select(*on, *[F.col(c).alias(f"__{c}") for c in parts])
    mixed = [((F.col("rows") * F.col(c) + PRIOR * F.col(f"__{c}")) / (F.col("rows") + PRIOR)).alias(c) for c in parts]
    return own.join(above, on).select(*[c for c in own.columns if c not in parts], *mixed)


def limits(measured: DataFrame) -> DataFrame:
    """(__lang, __source, high_*, low_*): the thresholds of every group of ``measured`` (__lang, __source, __failed, the ratios)."""
    passed = measured.where(~F.col("__failed"))
    fine = stored(sketches(passed, ["__lang", "__source"]), "sketches")
    by_lang = merged(fine, ["__lang"])
    # Quantiles over everything are a row a feature, and become constants through the driver's plan of 4 rows.
    spark = measured.sparkSession
    everything = spark.createDataFrame(quantiles(merged(fine, []), []).collect(), "feature string, rows long, lower double, middle double, upper double")
    of_lang = stored(blended(quantiles(by_lang, ["__lang"]), everything, ["feature"]), "quantiles")
    own = blended(quantiles(fine, ["__lang", "__source"]), of_lang, ["__lang", "feature"])
    # Groups without a passing document need no thresholds: the base rule rejects all of their rows.
    one = lambda k, c: F.max(F.when(F.col("feature") == k, c))
    high, low = F.col("upper") + REACH * (F.col("upper") - F.col("middle")), F.col("lower") - REACH * (F.col("middle") - F.col("lower"))
    return own.groupBy("__lang", "__source").agg(*[one(k, high).alias(f"high_{k}") for k in RATIOS], *[one(k, low).alias(f"low_{k}") for k in BOTH_SIDES])


def joined(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with the thresholds of its groups: broadcast if they are few, else a join that is salted against large groups."""
    on = ["__lang", "__source"]
    if limits.count() <= BROADCAST_GROUPS:
        return measured.join(F.broadcast(limits), on, "left")
    spread = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return measured.withColumn("__salt", F.pmod(F.xxhash64("__key", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(spread, [*on, "__salt"], "left")


def judged(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, BASE, base_failed, kept, the ratios, high_* and low_*) for every row, judged against its language's and source's own thresholds."""
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("__lang"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("__source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = stored(base_counts(own, text="__text").withColumns(ratios()).withColumn("__failed", failed), "counts")
    with scope(docs.sparkSession):
        thresholds = stored(limits(measured), "thresholds", keep=True)
    found = joined(measured, thresholds)
    inside = F.lit(True)
    for k, (count, over) in RATIOS.items():
        if k in BOTH_SIDES:
            inside &= F.col(k).between(F.col(f"low_{k}"), F.col(f"high_{k}"))
        else:
            most = F.col(f"high_{k}") * F.col(over)
            inside &= F.col(count) <= most + ERRORS * F.sqrt(most + 1)
    bounds = [f"high_{k}" for k in RATIOS] + [f"low_{k}" for k in BOTH_SIDES]
    return found.select(F.col("__key").alias(key), *BASE, F.col("__failed").alias("base_failed"), F.coalesce(~F.col("__failed") & inside, F.lit(False)).alias("kept"), *RATIOS, *bounds)
