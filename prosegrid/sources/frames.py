"""Any DataFrame as a source of payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.schema import payload


def from_frame(df: DataFrame, text_columns: Sequence[str], *, separator: str = " ", include_columns: Sequence[str] | None = None, payload_id: Column | None = None, source_name: str = "Pandas") -> DataFrame:
    """Payloads whose text joins ``text_columns`` in order (nulls are skipped); meta is the whole record unless columns are listed.

    Without ``payload_id`` a hash of the row identifies it, so that a retried task gives the same ids.
    """
    if not text_columns:
        raise ValueError("name at least one text column")
    if missing := [c for c in [*text_columns, *(include_columns or [])] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    text = F.concat_ws(separator, *[F.col(f"`{c}`").cast("string") for c in text_columns])
    meta = F.struct(*[F.col(f"`{c}`") for c in (include_columns if include_columns is not None else df.columns)])
    own = payload_id if payload_id is not None else F.lower(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    return payload(df, text, own, meta=meta, source_name=source_name)
