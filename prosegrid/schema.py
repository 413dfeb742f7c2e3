"""The payload row: one text with its origin, its metadata and what analyzers found in it.

A payload frame has the columns payload_id (stands for the position in a list), processed_text,
source_name, meta (a struct whose fields depend on the source), segmented_data (the closed set of
analyzer results) and, after splitting, splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "struct<entity_group:string,word:string,start:int,end:int,score:double>"
SPAN = "struct<entity_type:string,start:int,end:int,score:double>"
SEGMENTS = {
    "classifier_data": "map<string,double>",
    "ner_data": f"array<{ENTITY}>",
    "pii_data": f"struct<analyzer_result:array<{SPAN}>,anonymized_result:array<{SPAN}>,anonymized_text:string>",
    "translation_data": "struct<original_text:string>",
    "dummy_data": "string",
    "aggregator_data": "struct<avg_score:map<string,double>,category_count:map<string,int>,max_scores:map<string,double>,aggregator_name:string>",
}
SEGMENTED = "struct<" + ",".join(f"{k}:{v}" for k, v in SEGMENTS.items()) + ">"
SPLITTER = "struct<phrase:string,chunk_id:int,chunk_length:int,document_id:string,total_chunks:int>"


def no_segments() -> Column:
    """segmented_data before any analyzer has run."""
    return F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in SEGMENTS.items()])


def payload(df: DataFrame, text: Column, payload_id: Column, *, meta: Column | None = None, source_name: str = "Undefined") -> DataFrame:
    """A payload frame from any frame."""
    return df.select(
        payload_id.cast("string").alias("payload_id"),
        text.alias("processed_text"),
        F.lit(source_name).alias("source_name"),
        (meta if meta is not None else F.struct(F.lit(None).cast("string").alias("none"))).alias("meta"),
        no_segments().alias("segmented_data"),
    )


def with_segment(df: DataFrame, name: str, found: Column) -> DataFrame:
    """Adds a result to segmented_data; a result that is there already wins over the new one."""
    parts = [F.coalesce(F.col(f"segmented_data.{k}"), found.cast(kind) if k == name else F.lit(None).cast(kind)).alias(k) for k, kind in SEGMENTS.items()]
    return df.withColumn("segmented_data", F.struct(*parts))
