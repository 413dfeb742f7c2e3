"""Rendering of payloads: flat rows, JSON, nested bullet lists, shortened lines."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator, Mapping
from datetime import date, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegrid.functions.arrow import arrow_function


def plain(value: Any) -> Any:
    """Rows as dictionaries, recursively."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def flat_items(value: Mapping, separator: str = "_", digits: int | None = 2, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(joined key, leaf) pairs; of a list of records later ones win, a list of scalars is JSON, floats are text."""
    for key, item in value.items():
        name = f"{prefix}{separator}{key}" if prefix else str(key)
        if isinstance(item, Mapping):
            yield from flat_items(item, separator, digits, name)
        elif isinstance(item, (list, tuple)):
            records = [x for x in item if isinstance(x, Mapping)]
            if len(records) < len(item) or not item:
                yield name, to_json(item)
            for record in records:
                yield from flat_items(record, separator, digits, name)
        elif isinstance(item, float) and digits is not None:
            yield name, format(item, f".{digits}f")
        else:
            yield name, item


def flatten(value: Mapping, separator: str = "_", digits: int | None = 2) -> dict[str, Any]:
    return dict(flat_items(plain(value), separator, digits))


def to_json(value: Any) -> str | None:
    """JSON text with non-ASCII characters kept and ISO times; None stays None."""

    def other(x: Any) -> Any:
        return x.isoformat() if isinstance(x, (date, datetime)) else vars(x) if hasattr(x, "__dict__") else str(x)

    return None if value is None else json.dumps(plain(value), ensure_ascii=False, default=other)


def to_json_bytes(value: Any) -> bytes | None:
    text = to_json(value)
    return None if text is None else text.encode()


def bullets(value: Any, depth: int = 1, quote: tuple[str, str] | None = None) -> str:
    """A nested bullet list, one star a level; ``quote`` puts strings on a line of their own between two marks."""
    mark = "*" * depth

    def line(head: str, item: Any) -> str:
        if isinstance(item, (Mapping, list, tuple)):
            return f"{head}\n{bullets(item, depth + 1, quote)}"
        if quote and isinstance(item, str):
            return f"{head}:\n{quote[0]}{item}{quote[1]}"
        return f"{head}: {item}"

    value = plain(value)
    if isinstance(value, Mapping):
        return "\n".join(line(f"{mark} {k}", v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return "\n".join(line(mark, v) for v in value)
    return line(mark, value)


def shorten(text: str | None, width: int = 50) -> str | None:
    """The text with collapsed white space, cut at a word to ``width`` with `` [...]``."""
    return None if text is None else textwrap.shorten(text, width=width)


def shortened(text: Column, width: int = 50) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shorten(t, width))

    return run(text)


@arrow_function("string")
def two_digits(numbers: pd.Series) -> pd.Series:
    """Two decimals of the exact binary value; the JVM's formatting rounds its decimal rendering instead."""
    return numbers.map(lambda x: None if pd.isna(x) else format(x, ".2f"))


def flat_columns(schema: T.StructType, separator: str = "_") -> list[Column]:
    """Columns that flatten nested structs by the schema alone; arrays and maps become JSON, doubles two-digit text."""
    out: list[Column] = []

    def walk(fields: T.StructType, path: str, name: str) -> None:
        for f in fields:
            at, label = (f"{path}.`{f.name}`", f"{name}{separator}{f.name}") if path else (f"`{f.name}`", f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at, label)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(F.col(at)).alias(label))
            elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                out.append(two_digits(F.col(at).cast("double")).alias(label))
            else:
                out.append(F.col(at).alias(label))

    walk(schema, "", "")
    return out


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    return df.select(*flat_columns(df.schema, separator))
