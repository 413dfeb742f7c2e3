"""Vectorized functions that are declared before a session exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(kind)``, but the type is parsed on first use."""

    def wrap(function: Callable) -> Callable[..., Column]:
        @functools.wraps(function, assigned=("__name__", "__doc__"))
        def call(*columns: Column) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        return call

    return wrap
