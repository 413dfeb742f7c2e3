"""SimHash near-dedup at a Jaccard similarity: the Gray-ordered index at a wide distance, then an exact check.

Sets: the distinct XXH64 values of a text's shingles (words and shingles as in ``simhash``, five
words each). Two texts are linked if the Jaccard similarity of their sets is at least ``SIMILARITY``;
groups are the connected components of the links.

At a similarity of 0.8 the 64-bit fingerprints of two texts differ in 10 bits on average and in 20
now and then; one pair of unrelated texts in about 30 is within 24. So the SimHash fingerprint is
longer: WORDS words of 64 bits, the first that of ``simhash``, the others of the same hashes mixed
anew. Related texts differ in 77 of its 512 bits (96 for the shortest texts), unrelated ones in 256.

The fingerprints go into the Gray-ordered hierarchical index once for each of 56 blocks of nine
bits: a topmost node is a value of the block, below it the rows are in Gray order of another word
and runs of LEAF of them keep the mask and pattern of the bits on which they agree. A search goes
down from the node of its own value, drops runs and rows that differ in over ``NEAR`` bits of that word
and keeps rows within ``LIMIT`` bits of the whole. At 0.8 a pair agrees on no block with probability
5e-7 (texts of five shingles: 8e-5) and exceeds LIMIT with less than 1e-6. All texts meet: chunks of a hash
of at most ``PRINTS`` rows are joined pair by pair, each by a task. That work grows with the square of the texts
(one pair in 9 is looked at, for a few nanoseconds).

What the searches link, directly or not, is a family. Within it the 64-bit fingerprints are searched in
the index of ``simhash`` at ``WIDE`` bits, which two texts at 0.8 exceed with a probability of about 1e-7 (five shingles:
1e-5), and what that gives is checked by the exact Jaccard similarity.

Work: texts with equal sets are one node. Sets are made again from the texts, for families only. A
family of more than ``CHUNK`` shingles is cut into chunks by a hash, and every pair of chunks is a task
of its own, so no family has to fit in one task and no pair is lost. A task hands on a spanning
forest of its links.

Defined cases: null text has no words, and texts without a word are copies of each other; a row with
a null key is kept only if its group has no other; of rows with one key the first one is kept; very
long texts count as whole sets; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, partitions, releasing, scope, slices, stored, utf8
from prosegrid.llm.components import connected_components
from prosegrid.llm.simhash import GrayIndex, _join, gray_rank, shingle_hashes, simhash

SIMILARITY, WORDS_EACH = 0.8, 5
WORDS = 8  # of a long fingerprint
BLOCK, BLOCKS = 9, 7  # bits of a block, blocks of a word
NEAR, LIMIT = 24, 140  # bits of 64, bits of 512
LEAF = 32  # rows of a run in the index of long fingerprints
PRINTS, FEW_PRINTS = 1 << 19, 1 << 11  # long fingerprints of a chunk at most; fewer are not worth a chunk
WIDE = 28  # bits of 64
CHUNK = 1 << 20  # shingles
BROADCAST_ROWS = 1_000_000  # of two numbers
_AT_ONCE = 255  # shingles whose votes fit in a byte
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, WORDS - 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, words_each: int = WORDS_EACH) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return np.unique(np.array(shingle_hashes(text, words_each), np.uint64))


def signature(own: np.ndarray) -> np.ndarray:
    """The long SimHash fingerprint of a set: the words of majorities of its hashes and of these mixed anew (zeros for none)."""
    votes = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), _AT_ONCE):
        part = own[at : at + _AT_ONCE, None]
        mixed = part * _FACTORS[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTORS[1]
        words = np.hstack([part, mixed ^ (mixed >> np.uint64(32))])
        votes += np.add.reduce(np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(own), bitorder="little").view("<u8")


def block_values(words: np.ndarray, block: int) -> np.ndarray:
    """The bits of a block, of rows of long fingerprints."""
    word, at = divmod(block, BLOCKS)
    return ((words[:, word] >> np.uint64(BLOCK * at)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)


def band_values(own: np.ndarray) -> list[int]:
    """The number and bits of every block of a set's long fingerprint (none for an empty set)."""
    words = signature(own)[None]
    return [block << BLOCK | int(block_values(words, block)[0]) for block in range(WORDS * BLOCKS)] if len(own) else []


def sketched(rows: DataFrame, words_each: int) -> DataFrame:
    """(__place, fp, size, print) of rows (__place, __text); fp is the same for equal sets, print their long fingerprint."""
    sent = rows.select("__place", utf8("__text").alias("__text"))
    schema = extended(sent, ["__place"], "fp long, size long, print binary")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), words_each) for t in batch.column(1)]
        own = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = pa.array([signature(s).tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array([len(s) for s in sets], pa.int64()), prints], names=schema.names)

    return arrow_map(sent, make, schema)


class BlockIndex:
    """One word of fingerprints in Gray order below the values of a block, in runs of LEAF rows with their masks and patterns."""

    def __init__(self, words: np.ndarray, value: np.ndarray):
        order = np.lexsort((gray_rank(words), value))
        sizes = np.bincount(value, minlength=1 << BLOCK)
        self.sizes = -(-sizes // LEAF)  # runs of each value
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.work = self.sizes * LEAF
        local = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(self.starts * LEAF, sizes) + local
        runs = int(self.sizes.sum())
        self.rows, self.words = np.full(runs * LEAF, -1), np.zeros(runs * LEAF, np.uint64)
        self.rows[place], self.words[place] = order, words[order]
        first = np.flatnonzero(local % LEAF == 0)
        ones, zeros = ((np.bitwise_and.reduceat(x, first) if runs else x) for x in (words[order], ~words[order]))
        self.mask, self.pattern, self.words = ones | zeros, ones, self.words.reshape(-1, LEAF)

    def search(self, queries: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of equal value whose words differ in at most NEAR bits."""
        count = self.sizes[value]
        query = np.repeat(np.arange(len(queries)), count)
        run = np.arange(len(query)) + np.repeat(self.starts[value] - (np.cumsum(count) - count), count)
        near = np.bitwise_count((queries[query] ^ self.pattern[run]) & self.mask[run]) <= NEAR
        query, run = query[near], run[near]
        at = np.flatnonzero(np.bitwise_count(queries[query][:, None] ^ self.words[run]) <= NEAR)
        row = self.rows[run[at // LEAF] * LEAF + at % LEAF]
        return query[at // LEAF][row >= 0], row[row >= 0]


def near_prints(words: np.ndarray, side: np.ndarray, cross: bool, pairs_at_once: int = 1 << 16, joined_at_once: int = 1 << 20) -> np.ndarray:
    """For each row of long fingerprints a row of its class; if ``cross``, only pairs of side 0 and side 1 are searched."""
    parent = np.arange(len(words))
    asked, held = (np.flatnonzero(side == k) for k in (0, 1)) if cross else (parent.copy(),) * 2
    for block in range(WORDS * BLOCKS):
        value, word = block_values(words, block), words[:, (block // BLOCKS + 1) % WORDS]
        index = BlockIndex(word[held], value[held])
        queries = asked[np.argsort(value[asked], kind="stable")]
        work = np.cumsum(index.work[value[queries]])
        at, found, waiting = 0, [], 0
        while at < len(queries):
            upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + pairs_at_once)))
            part = queries[at:upto]
            q, row = index.search(word[part], value[part])
            a, b = part[q], held[row]
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= LIMIT
            found.append((a[near], b[near]))
            waiting += int(near.sum())
            at = upto
            if waiting and (waiting >= joined_at_once or at == len(queries)):
                _join(parent, *(np.concatenate(x) for x in zip(*found)))
                found, waiting = [], 0
    return parent


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the index of long fingerprints links; ``nodes`` has (fp, print), all fp differ."""
    spark, n = nodes.sparkSession, nodes.count()
    # A row is sent once a chunk, so there are no more of them than give each core two pairs, or than memory asks for.
    even = math.ceil((math.sqrt(16 * spark.sparkContext.defaultParallelism + 1) - 1) / 2)
    chunks = max(1, math.ceil(n / PRINTS), min(even, math.ceil(n / FEW_PRINTS)))
    own = nodes.select("fp", "print", F.pmod(F.xxhash64("fp"), F.lit(chunks)).cast("int").alias("own"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = met.select("fp", "print", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("cross"), (j * (j + 1) / 2 + i).cast("int").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cross = [], False
        for batch in batches:
            if batch.num_rows:
                own = batch["print"].cast(pa.binary(8 * WORDS))
                words = np.frombuffer(own.buffers()[1], "<u8").reshape(-1, WORDS)[own.offset : own.offset + len(own)]
                parts.append((batch["fp"].to_numpy().copy(), words.copy(), batch["side"].to_numpy().copy()))
                cross = batch["cross"][0].as_py()
        if not parts:
            return
        own, words, side = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        parent = near_prints(words, side, cross)
        moved = parent != np.arange(len(parent))
        yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[parent[moved]])], names=["a", "b"])

    return dealt.repartitionById(chunks * (chunks + 1) // 2, F.col("task")).mapInArrow(releasing(run), "a long, b long")


def forest(sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray, cross: bool, similarity: float) -> list[tuple[int, int]]:
    """Places (x, y) that connect all sets of at least the similarity; if ``cross``, only pairs of side 0 and side 1 count.

    ``prints`` are the sets' fingerprints, as unsigned words.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    label, out = np.arange(len(sets)), []
    asked, held = (np.flatnonzero(side == k) for k in (0, 1)) if cross else (np.arange(len(sets)),) * 2
    index = GrayIndex(prints[held], np.zeros(len(held), np.int64), 1)
    for x in asked.tolist():
        near = held[index.search(prints[x : x + 1], np.zeros(1, np.int64), WIDE)[1]]
        near = near[(label[near] != label[x]) & (np.minimum(sizes[near], sizes[x]) >= similarity * np.maximum(sizes[near], sizes[x]) - 1e-9)]
        for y in near.tolist():
            if label[y] == label[x]:
                continue
            small, large = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            shared = int(np.count_nonzero(large[at] == small))
            if shared >= similarity * (sizes[x] + sizes[y] - shared) - 1e-9:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def few(rows: DataFrame) -> DataFrame:
    """Rows of a number or two, broadcast if they are counted to be few; else the plan decides."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def links(nodes: DataFrame, texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what the links within families connect; ``nodes`` has (fp, size, print, __row), ``texts`` (__row, __text)."""
    family = connected_components(candidates(nodes.where("size > 0").select("fp", "print")))
    family = stored(nodes.select("fp", "size").join(family, F.col("fp") == F.col("node")).select("fp", "size", F.col("root").alias("family")), "families")
    chunks = family.groupBy("family").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    placed = family.join(chunks, "family").select("fp", "family", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("own"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "fp", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    places = stored(nodes.select("fp", "__row").join(family.select("fp"), "fp", "left_semi"), "places")
    sent = texts.join(few(places), "__row").select("fp", utf8("__text").alias("__text"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(t.as_py(), words_each) for t in batch.column(1)]
        prints = np.array([simhash(x) for x in own], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array([x.tobytes() for x in own], pa.binary())], names=["fp", "print", "own"])

    sets = stored(arrow_map(sent, pack, "fp long, print long, own binary"), "sets")
    keys = ["family", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in slices(batch) for row in zip(*(c.to_pylist() for c in part.columns)))
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            own = list(group)
            prints = np.array([r[5] for r in own], np.int64).view(np.uint64)
            found = forest([np.frombuffer(r[6], np.uint64) for r in own], prints, np.array([r[3] for r in own]), i != j, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([own[p[k]][4] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = tasks.join(sets, "fp").select(*keys, "side", "fp", "print", "own")
    return dealt.repartition(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(releasing(run), "a long, b long")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words_each: int = WORDS_EACH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each group of near copies: the one with the smallest key."""
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    with scope(docs.sparkSession):
        found = sketched(numbered.select(place.alias("__place"), F.col(text).alias("__text")), words_each)
        nodes = stored(found.groupBy("fp").agg(F.min("__place").alias("least"), F.first("size").alias("size"), F.first("print").alias("print")), "nodes")
        texts = numbered.select("__row", F.col(text).alias("__text"))
        roots = connected_components(links(nodes.select("fp", "size", "print", F.col("least.row").alias("__row")), texts, words_each, similarity))
        one = nodes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
        kept = stored(one.select(F.col("least.row").alias("__row")), "kept", keep=True)
    return numbered.join(few(kept), "__row", "left_semi").drop("__row")
