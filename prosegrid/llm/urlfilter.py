"""URL rules through Bloom filter cascades.

A rule is a host and the start of a path. The keys that could match a URL are its host and all
parent domains, each with the start of the path at each length that a rule has. The corpus's key
universe is the set of these keys over all its URLs. A cascade encodes a set of listed keys:
level 1 is a Bloom filter of the listed keys, level 2 one of the universe's other keys that pass
level 1, level 3 one of the listed keys that pass level 2, and so on until none passes. A key of
the universe is listed exactly if the first level that it fails has an even number (or if
it passes all levels and their number is odd), so that looking a key up needs no join.

There is a cascade for blocked and one for allowed rules. The longest listed key of a URL is its
rule; a URL without one gets the verdict ``allow``, as none of its keys is blocked.

What is broadcast is bounded: if the keys and the expected false positives would need filters of over
``FILTER_BYTES``, keys are cut into shards by their hash, each with cascades of its own, and the URLs
are passed once a shard, each pass keeping the longest key so far. Any number of keys is exact.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; ties in
length go to the longer host; repeated URLs are rows of their own; an empty table gives no rows;
columns named like an output column are dropped. A rule's path may be of any length, cut anywhere;
of very long URLs only host and path starts become keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, releasing, scope, stored, without

ADDED = ("host", "path", "rule", "verdict")
BITS_PER_KEY, HASHES = 10, 7
FALSE_POSITIVES = 0.01  # of the other keys, at most, for these figures
FILTER_BYTES = 64 << 20  # of filters that are broadcast at once, as expected
STATE = ("__rank", "__rule", "__verdict")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([n for n in map(rest.find, "/?#") if n >= 0], default=len(rest))
    host, path = rest[:end].translate(_ASCII_LOWER), rest[end:]
    return host, path[: min([n for n in map(path.find, "?#") if n >= 0], default=len(path))]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """The keys that a rule for this URL could have, longest first (then by longer host)."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))]
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts if h for n in lengths if n <= len(path)]
    return [key for _, _, key in sorted(found, reverse=True)]


@dataclass
class Bloom:
    """One level: an array of bits, and the seed that its hashes start from."""

    bits: np.ndarray  # uint8, eight bits each
    seed: int

    @staticmethod
    def places(key: str, seed: int, size: int) -> list[int]:
        a, b = xxhash.xxh64_intdigest(key, seed), xxhash.xxh64_intdigest(key, seed + 1) | 1
        return [((a + k * b) & 0xFFFFFFFFFFFFFFFF) % size for k in range(HASHES)]

    def __contains__(self, key: str) -> bool:
        size = len(self.bits) * 8
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.seed, size))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def bloom(keys: DataFrame, n: int, seed: int) -> Bloom:
    """A filter of the ``n`` rows of ``keys`` (column key): partial filters per task, then merged by word."""
    size = max(64, -(-n * BITS_PER_KEY // 64) * 64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in Bloom.places(key, seed, size):
                    bits[p >> 3] |= np.uint8(1 << (p & 7))
        words = bits.view("<i8")
        seen = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(words[seen])], names=["at", "word"])

    rows = keys.select("key").mapInArrow(releasing(part), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # the filter's bytes at most, twice
    out = np.zeros(size // 64, "<i8")
    out[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return Bloom(out.view(np.uint8), seed)


def passing(keys: DataFrame, level: Bloom) -> DataFrame:
    """The rows of ``keys`` that a filter lets through."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([k in shared.value for k in batch.column(0).to_pylist()], pa.bool_()))

    return arrow_map(keys.select("key"), make, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for all keys of ``universe`` and ``listed`` (distinct, column key).

    Joins take place here only, once per list, not when keys are looked up.
    """
    out = Cascade()
    inside, outside = listed, None
    while n := inside.count():
        level = bloom(inside, n, 2 * len(out.levels) + 1)
        out.levels.append(level)
        through = passing(universe if outside is None else outside, level)
        if outside is None:
            through = through.join(listed, "key", "left_anti")
        inside, outside = stored(through, "passed"), inside
    return out


def rule_key(host: str, path: str) -> str:
    return host.translate(_ASCII_LOWER) + path


def universe_of(pages: DataFrame, lengths: list[int], url: str = "url") -> DataFrame:
    """The distinct keys of all URLs (column key)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = {key for u in batch.column(0).to_pylist() for key in candidates(*split_url(u), lengths)}
        return pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

    return arrow_map(pages.select(F.col(url).alias("url")), make, "key string").distinct()


def shard_of(key: str, shards: int) -> int:
    """The shard of a key; ``in_shard`` is the same for columns."""
    own = xxhash.xxh64_intdigest(key, 42)
    return (own - (1 << 64) if own >> 63 else own) % shards


def in_shard(keys: DataFrame, number: int, shards: int) -> DataFrame:
    return keys if shards == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == number)


def build(allow: DataFrame, block: DataFrame, universe: DataFrame, number: int = 0, shards: int = 1) -> tuple[Cascade, Cascade]:
    """The cascades of the allowed and blocked keys (column key, distinct) of a shard over the universe."""
    own = in_shard(universe, number, shards)
    return build_cascade(in_shard(allow, number, shards), own), build_cascade(in_shard(block, number, shards), own)


def filter_urls(pages: DataFrame, allow: list[tuple[str, str]], block: list[tuple[str, str]], *, url: str = "url", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; rules are (host, path) pairs."""
    spark = pages.sparkSession
    pages = without(pages, ADDED)
    names = pages.columns
    lengths = sorted({len(p) for _, p in [*allow, *block]})
    table = lambda rules: spark.createDataFrame([(k,) for k in sorted({rule_key(*r) for r in rules})], "key string")
    lists = table(allow), table(block)
    universe = stored(universe_of(pages, lengths, url), "universe")
    bits = BITS_PER_KEY * (len({*allow, *block}) + 2 * FALSE_POSITIVES * universe.count())
    shards = max(1, int(-(-bits // (8 * filter_bytes))))
    schema = extended(pages, names, "host string, path string, __rank int, __rule string, __verdict string")
    out = pages.withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "__rank": F.lit(None).cast("int"), "__rule": F.lit(None).cast("string"), "__verdict": F.lit(None).cast("string")})
    for number in range(shards):
        with scope(spark):
            cascades = spark.sparkContext.broadcast(build(*lists, universe, number, shards))

        def make(batch: pa.RecordBatch, cascades=cascades, number=number) -> pa.RecordBatch:
            allowed, blocked = cascades.value
            known: dict[str, str | None] = {}
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            found = []
            for u, *before in zip(column(url).to_pylist(), *(column(n).to_pylist() for n in STATE)):
                host, path = split_url(u)
                best = tuple(before)
                for rank, key in enumerate(candidates(host, path, lengths)):
                    if best[0] is not None and best[0] <= rank:
                        break
                    if shards > 1 and shard_of(key, shards) != number:
                        continue
                    if key not in known:
                        known[key] = "block" if key in blocked else "allow" if key in allowed else None
                    if known[key]:
                        best = rank, key, known[key]
                        break
                found.append((host, path, *best))
            columns = [pa.array([row[k] for row in found], pa.int32() if k == 2 else pa.string()) for k in range(5)]
            return pa.RecordBatch.from_arrays([*[column(n) for n in names], *columns], names=[*names, *ADDED[:2], *STATE])

        out = arrow_map(stored(out, "urls") if number else out, make, schema)
    return out.select(*[f"`{c}`" for c in names], "host", "path", F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit("allow")).alias("verdict"))
