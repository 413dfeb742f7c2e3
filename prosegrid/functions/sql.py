"""Functions and a table function for SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from prosegrid.functions import cleaning, hashing, html, render, sentiment, stem
from prosegrid.operators.split import chunks


class TextChunks:
    """``SELECT d.id, c.* FROM docs d, LATERAL text_chunks(d.text, 512, 0) c``"""

    def eval(self, text: str, limit: int, stride: int) -> Iterator[tuple]:
        own = chunks(text or "", limit, stride)
        for n, phrase in enumerate(own):
            yield phrase, n, len(phrase), len(own)


def _vectorized(function: Callable, kind: str) -> Callable:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return pandas_udf(run, kind)


def register(spark: SparkSession) -> None:
    """Makes the engine's functions known to ``spark.sql``."""
    own = {
        "visible_text": (html.visible_text, "string"), "porter_stem": (stem.porter, "string"), "sentiment_compound": (sentiment.compound, "double"),
        "url_id": (hashing.hex_id, "string"), "shorten": (render.shorten, "string"), "decode_unicode": (cleaning.ascii_tokens, "array<string>"),
    }
    for name, (function, kind) in own.items():
        spark.udf.register(name, _vectorized(function, kind))
    spark.udtf.register("text_chunks", udtf(TextChunks, returnType="phrase string, chunk_id int, chunk_length int, total_chunks int"))
