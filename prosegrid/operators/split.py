"""Splitting texts into chunks: greedy packing of whole words, with optional overlap.

A chunk ends at the last of blank, line feed or tab at or before the limit; that character is
consumed. A word longer than the limit is cut at the limit. With a stride, a chunk after the first
starts after the white space at or before (end of the last chunk + 1 - stride). Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function
from prosegrid.functions.tokens import sentences


@dataclass
class SplitterConfig:
    max_split_length: int = 512
    split_stride: int = 0
    document_id_key: str | None = None
    enable_sentence_split: bool = False
    honor_paragraph_boundary: bool = False
    paragraph_marker: str = "\n\n"
    sentence_splitter: Callable[[Column], Column] = sentences


def boundary(text: str, at: int) -> int:
    """The last place at or before ``at`` where a chunk may end."""
    if at <= 0 or at >= len(text):
        return min(max(at, 0), len(text))
    return max(0, *(text.rfind(c, 0, at + 1) for c in " \n\t"))


def chunks(text: str, limit: int, stride: int = 0) -> list[str]:
    """The chunks of one segment; every step ends further on than the last, so any input ends."""
    out: list[str] = []
    start, ended = 0, 0
    while start < len(text):
        begin = boundary(text, start - stride) + 1 if stride > 0 and start > 0 else start
        end = boundary(text, min(begin + limit, len(text)))
        if end <= max(ended, begin - 1) and begin != start:  # the overlap leaves no room to advance
            begin = start
            end = boundary(text, min(begin + limit, len(text)))
        consumed = 1
        if end <= begin and not (end == begin and text[begin] in " \n\t"):
            end, consumed = min(begin + limit, len(text)), 0  # a word longer than the limit
        if end > begin:
            out.append(text[begin:end])
        ended, start = end, end + (consumed if end < len(text) else 1)
    return out


def _chunked(limit: int, stride: int) -> Callable[[Column], Column]:
    @arrow_function("array<string>")
    def run(segments: pd.Series) -> pd.Series:
        return segments.map(lambda own: [] if own is None else [c for s in own if s for c in chunks(s, limit, stride)])

    return run


def segments(text: Column, config: SplitterConfig) -> Column:
    """Paragraphs, then sentences, as configured."""
    parts = F.array(text)
    if config.honor_paragraph_boundary:
        parts = F.split(text, r"\Q" + config.paragraph_marker + r"\E", -1)
    if config.enable_sentence_split:
        parts = F.flatten(F.transform(parts, config.sentence_splitter))
    return parts


def split(payloads: DataFrame, config: SplitterConfig | None = None) -> DataFrame:
    """One row a chunk with its splitter struct; texts without a chunk have no row."""
    config = config or SplitterConfig()
    own = F.col("payload_id")
    if config.document_id_key:
        own = F.coalesce(F.col(f"meta.{config.document_id_key}").cast("string"), own)
    found = payloads.withColumn("__chunks", _chunked(config.max_split_length, config.split_stride)(segments(F.col("processed_text"), config)))
    rest = [F.col(c) for c in payloads.columns if c not in ("processed_text", "splitter")]
    exploded = found.select(*rest, own.alias("__document"), F.size("__chunks").alias("__total"), F.posexplode("__chunks").alias("__at", "processed_text"))
    return exploded.withColumn(
        "splitter",
        F.struct(
            F.col("processed_text").alias("phrase"), F.col("__at").alias("chunk_id"), F.length("processed_text").alias("chunk_length"),
            F.col("__document").alias("document_id"), F.col("__total").alias("total_chunks"),
        ),
    ).drop("__document", "__total", "__at")
