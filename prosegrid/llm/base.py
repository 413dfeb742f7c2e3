"""What the operators of this subpackage share: table access, shared scratch tables, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegrid.llm.cache import forget, trim
from prosegrid.scratch import scope, scratch_path, stored
from prosegrid.sources.tables import read_table as table

__all__ = ["arrow_map", "extended", "partitions", "releasing", "scope", "scratch_path", "slices", "stored", "table", "utf8", "without"]

BATCH_BYTES = 4 << 20  # of Arrow data that an operator's function sees at once


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (compared case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a string column."""
    return F.col(column).cast("binary")


def extended(df: DataFrame, names: Iterable[str], more: str = "") -> T.StructType:
    """The columns ``names`` of ``df`` with any type they have, then the columns of the DDL text ``more``."""
    kept = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType(kept + (T.StructType.fromDDL(more).fields if more else []))


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes, a row at least."""
    rows = batch.num_rows
    step = max(1, rows * most // max(1, batch.nbytes))
    return (batch.slice(at, step) for at in range(0, rows, step))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before which the worker drops the tables of other operators and after which it hands unused memory back.

    Workers outlive their tasks, and several share a machine; ``keeps`` is the loader whose tables stay.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return bounded


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, keeps: Callable | None = None) -> DataFrame:
    """Applies ``make`` to each Arrow batch, in parts of bounded bytes; nothing is kept between them but the tables of the loader ``keeps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := make(part)) is not None:
                    yield out

    return df.mapInArrow(releasing(run, keeps), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
