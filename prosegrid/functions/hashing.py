"""Murmur3 with 32 bits and seed 0 (Spark's own ``hash`` starts from 42 and pads differently)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function

_WORD = 0xFFFFFFFF


def _turn(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & _WORD


def _scramble(k: int) -> int:
    return _turn(k * 0xCC9E2D51 & _WORD, 15) * 0x1B873593 & _WORD


def murmur3(data: bytes, seed: int = 0) -> int:
    """The unsigned 32-bit hash, from the published algorithm (A. Appleby, public domain)."""
    state = seed
    whole = len(data) - len(data) % 4
    for at in range(0, whole, 4):
        state = (_turn(state ^ _scramble(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & _WORD
    state ^= _scramble(int.from_bytes(data[whole:], "little")) if whole < len(data) else 0
    state ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        state = (state ^ state >> shift) * factor & _WORD
    return state


def hex_id(text: str) -> str:
    """The hash in hexadecimal digits, at least two."""
    return format(murmur3(text.encode()), "02x")


@arrow_function("string")
def hex_id_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hex_id(t))
