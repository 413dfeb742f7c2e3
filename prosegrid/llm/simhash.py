"""SimHash near-duplicate detection with a Gray-ordered hierarchical index.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of four
words joined by spaces (repeats count; a shorter text is one shingle; no word: fingerprint 0),
XXH64 with seed 42, bit set if set in over half of the hashes.

Index: the distinct fingerprints of a task are sorted by Gray rank (the rank of a word in the
reflected Gray code, so neighbours share long bit patterns). Runs of FANOUT entries form a node
that keeps the mask of the bits on which all of them agree and the agreed pattern; the nodes are
grouped again up to the roots. A search goes down level by level and drops a whole node as soon as
the differences accumulated under its mask exceed the distance.

Distribution: if two 64-bit words differ in at most ``distance`` bits and the bits are cut into
``distance + r`` blocks, they agree on some ``r`` whole blocks. Fingerprints are dealt out by all
choices of r blocks and their value; the agreed blocks are the topmost node of the group. r grows
with the number of fingerprints so that groups stay small. Groups over a bound (counted first) are
cut into chunks by a hash, and every pair of chunks is a task of its own, so that no group has to
fit in one task and no pair is lost. A task hands on a spanning forest of its links instead of all
pairs; components are found over these edges.

Defined cases: null text has no words; empty table gives no rows; null doc_id takes part, but
never names a component (null if there is no other id); repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, partitions, scope, stored, utf8, without
from prosegrid.llm.components import connected_components

FANOUT = 8
CHUNK = 1 << 16  # fingerprints of one group that one task takes at most, twice
SEED = 42
ADDED = ("fingerprint", "component_id")


def shingle_hashes(text: bytes | None, words_each: int = 4) -> list[int]:
    """XXH64 of every shingle of a UTF-8 text; repeats included."""
    words = text.lower().split() if text else []  # bytes: only A-Z and only ASCII white space
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words_each - 1 :].tolist())]


def simhash(hashes: list[int] | np.ndarray) -> int:
    """The majority word of unsigned 64-bit hashes (0 for none)."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts in pieces
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", words_each: int = 4) -> DataFrame:
    """``docs`` without the text column, with ``fp`` (the fingerprint as a signed long)."""
    rest = [c for c in without(docs, ["fp"]).columns if c != text]
    sent = docs.select(*rest, utf8(text).alias("__text"))
    schema = extended(sent, rest, "fp long")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhash(shingle_hashes(t.as_py(), words_each)) for t in batch.column(len(rest))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*rest, "fp"])

    return arrow_map(sent, make, schema)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code (prefix exclusive-or of its bits)."""
    out = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Nodes over fingerprints in Gray order, for many groups at once; level 0 is the fingerprints.

    ``words`` and ``group`` (ascending) are parallel; a node never reaches over two groups.
    """

    def __init__(self, words: np.ndarray, group: np.ndarray, groups: int):
        self.order = np.lexsort((gray_rank(words), group))
        self.words = words[self.order]
        sizes = np.bincount(group, minlength=groups)
        ones, zeros = self.words, ~self.words  # bits that are set, or clear, in all of a node
        #: For each level above 0, from the leaves: mask, pattern, first child and number of children of its nodes.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes  # of the groups' nodes on the topmost level
            if sizes.max(initial=0) <= FANOUT and self.levels:
                return
            above = -(-sizes // FANOUT)
            local = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
            first = np.repeat(self.starts, above) + local * FANOUT
            held = np.minimum(FANOUT, np.repeat(sizes, above) - local * FANOUT)
            if len(first):
                ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones | zeros, ones, first, held))
            sizes = above

    @staticmethod
    def _spread(query: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, first + k) for each k below count."""
        return np.repeat(query, count), np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)

    def search(self, queries: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``words`` as given) of one group within the distance."""
        query, node = self._spread(np.arange(len(queries)), self.starts[group], self.sizes[group])
        for mask, pattern, first, held in reversed(self.levels):
            near = np.bitwise_count((queries[query] ^ pattern[node]) & mask[node]) <= distance
            query, node = self._spread(query[near], first[node[near]], held[node[near]])
        near = np.bitwise_count(queries[query] ^ self.words[node]) <= distance
        return query[near], self.order[node[near]]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the classes of a and b; parents are flat before and after, and least places are roots."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(above := parent[parent], parent):
            parent[:] = above


def forest(words: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, distance: int, pairs_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Edges (word, root word) that connect all links within each of many groups of distinct words.

    ``group`` ascends from 0; where ``cross`` holds for a row's group (a pair of chunks), only links
    between words of side 0 and side 1 count.
    """
    parent, groups = np.arange(len(words)), int(group[-1]) + 1 if len(group) else 0
    held = np.flatnonzero(~cross | (side == 1))
    asked = np.flatnonzero(~cross | (side == 0))
    index = GrayIndex(words[held], group[held], groups)
    # Queries are taken in blocks whose pairs fit in memory even if no node can be dropped.
    work = np.cumsum(np.bincount(group[held], minlength=groups)[group[asked]])
    at = 0
    while at < len(asked):
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + pairs_at_once)))
        part = asked[at:upto]
        q, found = index.search(words[part], group[part], distance)
        _join(parent, part[q], held[found])
        at = upto
    moved = parent != np.arange(len(words))
    return words[moved], words[parent[moved]]


def block_masks(distance: int, chosen: int) -> list[int]:
    """The masks of all choices of ``chosen`` of ``distance + chosen`` blocks of the 64 bits."""
    blocks = distance + chosen
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(x) for x in combinations(single, chosen)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, n: int, distance: int, at_once: int = 1 << 17) -> DataFrame:
    """Edges (a, b) over the distinct longs ``fp`` that connect exactly what links within ``distance`` connect."""
    chosen = 1
    while chosen < 3 and n >> (64 * chosen // (distance + chosen)) > 2048:
        chosen += 1
    masks = block_masks(distance, chosen)
    width = partitions(distinct.sparkSession)
    bound = min(CHUNK, max(64, len(masks) * n // (4 * width)))
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("block", "value"))
    # Below the fixed bound at most 4 * width groups are large; beyond it their number grows, so the plan decides whether to broadcast them.
    large = dealt.groupBy("block", "value").count().where(F.col("count") > bound).select("block", "value", F.ceil(F.col("count") / bound).cast("int").alias("chunks"))
    placed = dealt.join(large, ["block", "value"], "left").select(
        "fp", "block", "value", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int").alias("own")
    )
    tasks = placed.select("fp", "block", "value", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "fp", "block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    keys = ["block", "value", "i", "j"]

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        own = [rows[c].to_numpy() for c in keys]
        new = np.zeros(len(rows), bool)
        for x in own:
            new[1:] |= x[1:] != x[:-1]
        a, b = forest(rows["fp"].to_numpy().view(np.uint64), np.cumsum(new), rows["side"].to_numpy(), own[2] != own[3], distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by group; those of the last group wait until it is complete.
        held, waiting = [], 0
        for rows in batches:
            own = rows[keys].to_numpy()
            cut = int(np.flatnonzero((own != own[-1]).any(axis=1))[-1]) + 1 if len(own) and (own != own[-1]).any() else 0
            if held and not cut and len(own) and (held[-1][keys].iloc[-1].to_numpy() != own[0]).any():
                yield edges(pd.concat(held))
                held, waiting = [], 0
            elif cut and waiting + cut >= at_once:
                yield edges(pd.concat([*held, rows.iloc[:cut]]))
                held, waiting, rows = [], 0, rows.iloc[cut:]
            held.append(rows)
            waiting += len(rows)
        if waiting:
            yield edges(pd.concat(held))

    return tasks.repartition(width, *keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_each: int = 4, distance: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the least key that links reach."""
    found = stored(fingerprints(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), text="__text", words_each=words_each), "fingerprints")
    with scope(docs.sparkSession):
        named = stored(_components(found, distance), "components", keep=True)
    return found.join(named, "fp").select(F.col("__key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(found: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id) of all fingerprints of (__key, fp)."""
    distinct = stored(found.groupBy("fp").agg(F.min("__key").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), distinct.count(), distance))
    rooted = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_each: int = 4, distance: int = 4) -> DataFrame:
    """One row of ``docs`` of each group: the one with the smallest key, of equal keys the first; a null key comes last."""
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    found = near_duplicates(numbered.select(place.alias("__place"), F.col(text).alias("__text")), key="__place", text="__text", words_each=words_each, distance=distance)
    kept = found.select(F.col("component_id.row").alias("__row")).distinct()
    return numbered.join(kept, "__row", "left_semi").drop("__row")
