"""Aggregation of chunk results back to documents.

The chunks of a document meet once, as its text has to be put together again; everything else is
computed from that array by JVM functions. So there is one shuffle, no join, and what made the
chunks runs once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.schema import SEGMENTS

KIND = SEGMENTS["aggregator_data"]
FIELDS = ("payload_id", "processed_text", "source_name", "meta", "segmented_data")


def _scores(chunk: Column) -> Column:
    return chunk["segmented_data"]["classifier_data"]


def _labels(chunks: Column) -> Column:
    """All labels of the chunks, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.coalesce(F.map_keys(_scores(c)), F.array().cast("array<string>"))))))


def _total_length(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.length(c["processed_text"]))


def _data(name: str, **found: Column) -> Column:
    """An aggregator_data struct with the given fields."""
    names = ("avg_score", "category_count", "max_scores")
    return F.struct(*[found.get(n, F.lit(None)).alias(n) for n in names], F.lit(name).alias("aggregator_name")).cast(KIND)


@dataclass
class AverageScore:
    """label -> default + sum of score * length of the chunk / length of all chunks; a missing label adds nothing."""

    default_value: float = 0.0
    name: str = "ClassificationAverageScore"

    def __call__(self, chunks: Column) -> Column:
        total = _total_length(chunks)

        def mean(label: Column) -> Column:
            weighted = F.aggregate(chunks, F.lit(0.0), lambda s, c: s + F.coalesce(_scores(c)[label] * F.length(c["processed_text"]), F.lit(0.0)))
            return F.lit(self.default_value) + weighted / F.greatest(total, F.lit(1))

        return _data(self.name, avg_score=F.map_from_entries(F.transform(_labels(chunks), lambda x: F.struct(x, mean(x)))))


@dataclass
class MaxCategories:
    """label -> number and maximum of the scores above the threshold; labels without one are left out."""

    score_threshold: float = 0.5
    name: str = "ClassificationMaxCategories"

    def __call__(self, chunks: Column) -> Column:
        above = lambda label: F.filter(F.transform(chunks, lambda c: _scores(c)[label]), lambda s: s > self.score_threshold)
        labels = F.filter(_labels(chunks), lambda x: F.size(above(x)) > 0)
        return _data(
            self.name,
            category_count=F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.size(above(x))))),
            max_scores=F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.array_max(above(x))))),
        )


@dataclass
class Custom:
    """A plug-in: any function from the array of a document's payloads (in order) to label -> score."""

    compute: Callable[[Column], Column]
    name: str = "Custom"

    def __call__(self, chunks: Column) -> Column:
        return _data(self.name, avg_score=self.compute(chunks))


def aggregate(payloads: DataFrame, function: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a document with only aggregator_data as result, its chunks' texts joined by a blank.

    meta is the last chunk's, the source the first one's. A payload without a splitter is a document of
    one chunk. Documents whose first chunk is not classified pass unchanged, chunk by chunk.
    """
    split = "splitter" in payloads.columns
    document = F.coalesce(F.col("splitter.document_id"), F.col("payload_id")) if split else F.col("payload_id")
    order = F.coalesce(F.col("splitter.chunk_id"), F.lit(0)) if split else F.lit(0)
    place = lambda c: F.struct(c["order"], c["payload_id"])
    by_order = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    grouped = payloads.groupBy(document.alias("__document")).agg(F.collect_list(F.struct(order.alias("order"), *FIELDS)).alias("__chunks"))
    chunks = F.col("__chunks")
    sorted_ = grouped.withColumn("__chunks", F.array_sort("__chunks", by_order))
    segmented = F.struct(*[((function or AverageScore())(chunks) if k == "aggregator_data" else F.lit(None).cast(t)).alias(k) for k, t in SEGMENTS.items()])
    first, last = F.get(chunks, F.lit(0)), F.element_at(chunks, -1)
    whole = F.struct(
        first["payload_id"].alias("payload_id"), F.array_join(F.transform(chunks, lambda c: c["processed_text"]), " ").alias("processed_text"),
        first["source_name"].alias("source_name"), last["meta"].alias("meta"), segmented.alias("segmented_data"),
    )
    same = F.transform(chunks, lambda c: F.struct(*[c[f].alias(f) for f in FIELDS]))
    return sorted_.select(F.explode(F.when(_scores(first).isNotNull(), F.array(whole)).otherwise(same)).alias("__row")).select("__row.*")
