"""Benchmark decontamination with a stored positional inverted index of all training terms.

Index: one pass over the corpus cuts it into segments of about ``SEGMENT_WORDS`` words and writes, for
each segment, the posting list of every term (ascending positions) and a row for each document
(its first position and number of words). Positions count through the documents with a gap after
each, so nothing spans two of them. A document lies in one segment, so a common word has a bounded
list in each of many segments, and no list grows with the corpus.

Search: the lists of the benchmark's terms are read from the table, and their lengths are summed over
all segments. Each segment's lists come together in one task, where for every phrase the lists
are intersected from the term that is rarest in the whole corpus on, each list adjusted by the
term's offset in the phrase: what is left are the exact occurrences. ``proximity`` asks the same
lists for terms that stand within a span of each other. The corpus is read once; a stored index
answers further benchmarks.

The benchmark is a query set: it is taken in blocks of at most ``BLOCK_WORDS`` words, which bounds
what is broadcast; each block reads its own lists, and hits are merged.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Phrases: windows of 13
consecutive words of an item; an item of fewer words (but not none) is one window.

Defined cases: null and empty texts have no words; items without words ask for nothing; items
with the same id are one item; an item without an id hits, under the empty id; very long texts
make a segment of their own; repeated rows are rows of their own; an empty table gives no rows, an
empty benchmark no hits; columns named like an output column are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegrid.llm.base import partitions, releasing, scope, slices, stored, utf8, without

WINDOW = 13
BLOCK_WORDS = 500_000
CANDIDATES = 1 << 20  # pairs that are looked at together
SEGMENT_WORDS = 1 << 20
BROADCAST_ROWS = 1_000_000  # digests of 16 bytes
SEGMENTS = 20  # bits of a segment's number within its task
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")
LISTS = "segment long, term binary, n int, positions binary"
#: A document of a segment: its place, first position, number of words, and what has been found in it.
PLACED = "segment long, place int, first int, n_words long, hits array<int>, items array<string>"
_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.lower().translate(_SPACED).split() if text else []


@dataclass
class Phrases:
    """A block of the benchmark: the number of each term, and by length the windows with their items."""

    terms: dict[bytes, int]
    windows: dict[int, tuple[np.ndarray, np.ndarray]]
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Phrases:
        terms: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for name, words in items:
            if not words:
                continue
            own = np.array([terms.setdefault(w, len(terms)) for w in words], np.int32)
            n = min(window, len(own))
            rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(own, n))
            owners.setdefault(n, []).append(np.full(len(own) - n + 1, names.setdefault(name, len(names)), np.int32))
        return cls(terms, {n: (np.concatenate(rows[n]), np.concatenate(owners[n])) for n in rows}, list(names))


class Segment:
    """Documents that are indexed together."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.words = 0

    def add(self, text: bytes | None) -> None:
        words, terms = words_of(text), self.terms
        self.codes.append(np.array([terms.setdefault(w, len(terms)) for w in words], np.int32))
        self.sizes.append(len(words))
        self.words += len(words)

    def firsts(self) -> np.ndarray:
        """The first position of each document; there is a gap of one position after each."""
        sizes = np.array(self.sizes, np.int64)
        return np.cumsum(sizes + 1) - (sizes + 1)

    def lists(self) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """(terms, lengths of their lists, their positions as little-endian int32)."""
        codes = np.concatenate([*self.codes, np.empty(0, np.int32)])
        positions = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        positions = positions[np.argsort(codes, kind="stable")].astype("<i4")
        counts = np.bincount(codes, minlength=len(self.terms))
        ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(positions)])
        return pa.array(list(self.terms), pa.binary()), counts.astype(np.int32), packed


class PositionalIndex:
    """The posting lists of one segment, for terms by their numbers in a block of phrases."""

    def __init__(self, sizes: np.ndarray, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, n_terms: int):
        """``terms`` ascend; ``positions`` holds their lists one after the other, ``counts`` the lengths."""
        self.sizes, self.first = sizes, first
        self.span = int((sizes + 1).sum()) + 1
        self.postings = positions.astype(np.int64)
        self.counts = np.zeros(n_terms, np.int64)
        self.counts[terms] = counts
        self.starts = np.zeros(n_terms, np.int64)
        self.starts[terms] = np.cumsum(counts) - counts
        self.keys = np.repeat(terms.astype(np.int64), counts) * self.span + self.postings  # ascending

    @classmethod
    def of_words(cls, documents: list[list[bytes]], terms: dict[bytes, int]) -> PositionalIndex:
        segment = Segment()
        for d in documents:
            segment.add(b" ".join(d))
        names, counts, packed = segment.lists()
        known = sorted((terms[w], k) for k, w in enumerate(names.to_pylist()) if w in terms)
        order = np.array([k for _, k in known], np.int64)
        lists = [np.frombuffer(packed[k].as_py(), "<i4") for k in order.tolist()]
        return cls(np.array(segment.sizes, np.int64), segment.firsts(), np.array([t for t, _ in known], np.int64), counts[order], np.concatenate([*lists, np.empty(0, np.int32)]), len(terms))

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term's list has each position."""
        wanted = terms * self.span + positions
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return (positions >= 0) & (positions < self.span) & (self.keys[at] == wanted)

    def phrases(self, windows: np.ndarray, rarity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position) of every exact occurrence, in blocks; ``rarity`` is each term's number of postings in the corpus."""
        length = windows.shape[1]
        alive = np.flatnonzero(self.counts[windows].min(axis=1) > 0)
        order = np.argsort(rarity[windows[alive]], axis=1, kind="stable")  # offsets, the rarest term first
        total = np.cumsum(self.counts[windows[alive, order[:, 0]]]) if len(alive) else np.empty(0, np.int64)
        at = 0
        while at < len(alive):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES)))
            rows = np.arange(at, upto)
            rarest = windows[alive[rows], order[rows, 0]]
            number = self.counts[rarest]
            row = np.repeat(rows, number)
            list_at = np.arange(number.sum()) + np.repeat(self.starts[rarest] - (np.cumsum(number) - number), number)
            place = self.postings[list_at] - order[row, 0]
            for k in range(1, length):
                offset = order[row, k]
                both = self.holds(windows[alive[row], offset].astype(np.int64), place + offset)
                row, place = row[both], place[both]
            yield alive[row], place
            at = upto

    def proximity(self, terms: np.ndarray, span: int, rarity: np.ndarray) -> np.ndarray:
        """Positions of the rarest of ``terms`` that have all the others within ``span`` words, in one document."""
        terms = np.unique(terms)
        if not len(terms) or not (self.counts[terms] > 0).all():
            return np.empty(0, np.int64)
        lists = [self.postings[self.starts[t] : self.starts[t] + self.counts[t]] for t in sorted(terms.tolist(), key=lambda t: (rarity[t], t))]
        place = lists[0]
        for other in lists[1:]:
            document = np.searchsorted(self.first, place, "right") - 1
            low = np.maximum(place - span, self.first[document])
            high = np.minimum(place + span, self.first[document] + self.sizes[document])
            place = place[np.searchsorted(other, low) < np.searchsorted(other, high, "right")]
        return place


def search(index: PositionalIndex, phrases: Phrases, rarity: np.ndarray) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document the positions of its hit words, and the ids of the items that occur in it."""
    change = np.zeros(index.span + 1, np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    for length, (windows, owner) in phrases.windows.items():
        for window, place in index.phrases(windows, rarity):
            np.add.at(change, place, 1)
            np.add.at(change, place + length, -1)
            document = np.searchsorted(index.first, place, "right") - 1
            pairs.append(np.unique(np.stack([document, owner[window]], axis=1), axis=0))
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    document = np.searchsorted(index.first, hit, "right") - 1
    cuts = np.searchsorted(document, np.arange(len(index.sizes) + 1))
    items: list[list[str]] = [[] for _ in index.sizes]
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
        items[d].append(phrases.items[i])
    return [hit[cuts[d] : cuts[d + 1]] - index.first[d] for d in range(len(index.sizes))], items


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items, in blocks of about ``most`` words, one row at a time."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), utf8(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append((row["i"], words))
        size += len(words)
    yield held


def build_index(docs: DataFrame, *, text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of ``docs`` as rows of two kinds: LISTS of a segment's terms, and PLACED documents with ``own``, their other columns.

    It is to be stored: segments are named by the tasks that make them.
    """
    rest = [c for c in docs.columns if c != text]
    sent = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("own"), utf8(text).alias("__text"))
    schema = T.StructType(T.StructType.fromDDL(LISTS).fields + T.StructType.fromDDL(PLACED).fields[1:] + [T.StructField("own", sent.schema["own"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        segment, held = Segment(), []

        def rows(size: int, kind_of_own: pa.DataType, **known: object) -> pa.RecordBatch:
            kinds = {"segment": pa.int64(), "term": pa.binary(), "n": pa.int32(), "positions": pa.binary(), "place": pa.int32(), "first": pa.int32(), "n_words": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "own": kind_of_own}
            known["segment"] = np.full(size, task << SEGMENTS | number)
            return pa.RecordBatch.from_arrays([known[k] if isinstance(known.get(k), pa.Array) else pa.array(known[k], kind) if k in known else pa.nulls(size, kind) for k, kind in kinds.items()], names=list(kinds))

        def emit() -> Iterator[pa.RecordBatch]:
            own = pa.concat_arrays(held)
            yield rows(len(own), own.type, place=np.arange(len(own)), first=segment.firsts(), n_words=np.array(segment.sizes), own=own)
            terms, counts, packed = segment.lists()
            if len(terms):
                yield from slices(rows(len(terms), own.type, term=terms, n=counts, positions=packed))

        for batch in batches:
            for part in slices(batch):
                low = 0
                for at, text in enumerate(part.column(1), 1):
                    segment.add(text.as_py())
                    if segment.words >= segment_words or at == part.num_rows:
                        held.append(part.column(0).slice(low, at - low))
                        low = at
                    if segment.words >= segment_words:
                        yield from emit()
                        segment, held, number = Segment(), [], number + 1
        if held:
            yield from emit()

    return sent.mapInArrow(releasing(run), schema)


def lists_of(index: DataFrame, phrases: Phrases) -> tuple[DataFrame, np.ndarray]:
    """The lists of a block's terms (segment, number, n, positions), and the number of postings of each term in the corpus."""
    spark = index.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.array(list(phrases.terms), pa.binary()), "number": pa.array(range(len(phrases.terms)), pa.int32())}))
    found = index.where("term is not null").join(F.broadcast(terms), "term").select("segment", "number", "n", "positions")  # at most BLOCK_WORDS terms
    rarity = np.zeros(len(phrases.terms), np.int64)
    sums = found.groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    rarity[sums.column("number").to_numpy()] = sums.column("n").to_numpy()
    return found, rarity


def _by_segment(placed: DataFrame, lists: DataFrame, make, schema: T.StructType) -> DataFrame:
    """``make(documents, lists)`` for each segment, with the rows of documents and the rows of lists as Arrow tables."""
    width = partitions(placed.sparkSession)
    deal = F.pmod(F.shiftright("segment", SEGMENTS) + F.col("segment").bitwiseAND((1 << SEGMENTS) - 1) * 7919, F.lit(width)).cast("int")
    both = placed.unionByName(lists, allowMissingColumns=True).repartitionById(width, deal).sortWithinPartitions("segment", F.col("number").asc_nulls_first(), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            n = whole.num_rows - whole.column("number").null_count
            documents, own = whole.slice(0, whole.num_rows - n), whole.slice(whole.num_rows - n)
            if documents.num_rows:
                yield from make(documents, own)

        for batch in batches:
            own = batch.column(batch.schema.get_field_index("segment")).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for low, high in zip(cuts, cuts[1:]):
                if held and own[low] != held[-1].column(held[-1].schema.get_field_index("segment"))[0].as_py():
                    yield from emit()
                    held.clear()
                held.append(batch.slice(low, high - low))
        if held:
            yield from emit()

    return both.mapInArrow(releasing(run), schema)


def _positional(documents: pa.Table, lists: pa.Table, n_terms: int) -> PositionalIndex:
    numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    positions = np.frombuffer(b"".join(lists.column("positions").to_pylist()), "<i4")
    return PositionalIndex(numbers(documents, "n_words"), numbers(documents, "first"), numbers(lists, "number"), numbers(lists, "n"), positions, n_terms)


def match(placed: DataFrame, lists: DataFrame, block: Broadcast) -> DataFrame:
    """``placed`` documents with the hits and items of a block added; ``block`` holds (Phrases, rarity)."""
    names = placed.columns

    def make(documents: pa.Table, own: pa.Table) -> Iterator[pa.RecordBatch]:
        phrases, rarity = block.value
        hits, items = search(_positional(documents, own, len(rarity)), phrases, rarity)
        new = {"hits": [x.tolist() for x in hits], "items": items}
        for c, kind in (("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))):
            if documents.column(c).null_count < documents.num_rows:  # of an earlier block
                new[c] = [sorted({*(a or ()), *b}) for a, b in zip(documents.column(c).to_pylist(), new[c])]
            documents = documents.set_column(documents.column_names.index(c), c, pa.array(new[c], kind))
        yield from documents.select(names).combine_chunks().to_batches()

    return _by_segment(placed, lists, make, placed.schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without the text, with n_words, n_hit, n_items, items (ids as strings) and contaminated.

    A document is contaminated if at least one word in 20 is hit.
    """
    with scope(docs.sparkSession):
        index = stored(build_index(without(docs, ADDED), text=text), "index")
        found = contamination_by(index, benchmark, item=item, item_text=item_text, window=window, block_words=block_words)
        return stored(found, "contamination", keep=True)


def contamination_by(index: DataFrame, benchmark: DataFrame, *, item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The same from a stored index."""
    names = [f.name for f in index.schema["own"].dataType.fields[1:]]
    out = index.where("term is null").select(*[c.split()[0] for c in PLACED.split(", ")], "own")
    for number, items in enumerate(_blocks(benchmark, item, item_text, block_words)):
        phrases = Phrases.of(items, window)
        if phrases.terms:
            lists, rarity = lists_of(index, phrases)
            block = index.sparkSession.sparkContext.broadcast((phrases, rarity))  # at most block_words words
            out = match(stored(out, "hits") if number else out, lists, block)
    n_hit = F.coalesce(F.array_size("hits"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"own.`{c}`") for c in names], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.array_sort(items).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(index: DataFrame, queries: list[tuple[str, str]], span: int) -> DataFrame:
    """(the documents' own columns, query, position) of each place where all words of a query stand within ``span`` words.

    The position is that of the query's word that is rarest in the corpus; ``queries`` are (name, words), and few: they are broadcast.
    """
    names = [f.name for f in index.schema["own"].dataType.fields[1:]]
    phrases = Phrases.of([(name, words_of(words.encode())) for name, words in queries], 1 << 30)
    asked = [(phrases.items[owner[k]], windows[k]) for windows, owner in phrases.windows.values() for k in range(len(windows))]
    lists, rarity = lists_of(index, phrases)
    shared = index.sparkSession.sparkContext.broadcast((asked, rarity))
    placed = index.where("term is null").select(*[c.split()[0] for c in PLACED.split(", ")], "own")
    schema = T.StructType([index.schema["own"], *T.StructType.fromDDL("query string, position long").fields])

    def make(documents: pa.Table, own: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, rarity = shared.value
        at = _positional(documents, own, len(rarity))
        for name, terms in asked:
            place = at.proximity(terms, span, rarity)
            if len(place):
                document = np.searchsorted(at.first, place, "right") - 1
                rows = documents.column("own").combine_chunks().take(pa.array(document))
                yield pa.RecordBatch.from_arrays([rows, pa.array([name] * len(place)), pa.array(place - at.first[document])], names=["own", "query", "position"])

    return _by_segment(placed, lists, make, schema).select(*[F.col(f"own.`{c}`") for c in names], "query", "position")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    digest = F.unhex(F.md5(F.col(text).cast("binary")))  # the verdict follows from the text alone
    with scope(docs.sparkSession):
        found = contamination(docs.select(digest.alias("__digest"), F.col(text).alias("__text")), benchmark, text="__text")
        bad = stored(found.where("contaminated").select("__digest").distinct(), "contaminated", keep=True)
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, digest == F.col("__digest"), "left_anti")
