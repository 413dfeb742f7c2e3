"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; runs of other ASCII characters than letters count as blanks. All n-grams of
one to three code points are hashed into ``BUCKETS`` buckets. Training sums bucket counts per
language over all labelled rows (partial tables of each task, then a grouped sum). The matrix of
log probabilities has one column a language; it is collected and broadcast in blocks of
``BLOCK`` languages, so any number of them is learned, and a further block costs a further pass.

Scoring takes the texts of a batch together: the bucket counts of a group of texts are made at
once, the entries that are not zero gather the matrix rows, and the products are summed per text.
Languages are equally likely beforehand, so a rare language is not held against a text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, so are all texts if
nothing was learned; ties go to the first language by name; rows with a null label or a null key
are never learned from; very long texts are counted in pieces of bounded size; repeated rows count
each; an empty table gives no rows; columns named like an output column are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, releasing, scope, stored, without

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
STATE = ("__language", "__best", "__all")
BLOCK = 128  # languages of one matrix
TEXTS = 32  # whose buckets are counted together
TABLES = 64  # of bucket counts that a training task holds
PIECE = 1 << 18  # code points that are looked at together
_BLANK = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def features(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, in pieces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    ascii_ = codes < 128
    codes = np.where(ascii_, _BLANK[np.where(ascii_, codes, 0)], codes)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + max(ORDERS) - 1]
        for n in ORDERS:
            count = min(PIECE, len(piece) - n + 1)
            if count <= 0:
                continue
            mixed = np.full(count, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ piece[k : k + count]) * _MIX[k]
                mixed ^= mixed >> np.uint32(15)
            yield mixed & np.uint32(BUCKETS - 1)


def bucket_counts(texts: list[str | None]) -> np.ndarray:
    """(texts x BUCKETS) counts of the n-grams of each text."""
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    held: list[np.ndarray] = []
    size = 0
    for row, text in enumerate(texts):
        for f in features(text) if text else ():
            held.append(f.astype(np.int64) + row * BUCKETS)
            size += len(f)
            if size >= PIECE:
                out += np.bincount(np.concatenate(held), minlength=len(out))
                held, size = [], 0
    if held:
        out += np.bincount(np.concatenate(held), minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


@dataclass
class Block:
    """Languages in the order of their names, with the log probability of each bucket (BUCKETS x languages)."""

    languages: list[str]
    log_probability: np.ndarray

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """(texts x languages) log likelihoods, by a sparse product over a group of texts."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), TEXTS):
            counts = bucket_counts(texts[at : at + TEXTS])
            row, bucket = np.nonzero(counts)
            if not len(row):
                continue
            each = counts[row, bucket]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            step = max(1, PIECE // max(1, len(self.languages) // 8))  # entries whose products are held at once
            for low, high in zip(first, np.append(first[1:], len(row))):
                for k in range(low, high, step):
                    upto = min(high, k + step)
                    out[at + row[low]] += each[k:upto] @ self.log_probability[bucket[k:upto]].astype(np.float64)
        return out


@dataclass
class Model:
    blocks: list[Block] = field(default_factory=list)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most likely language of one text and its posterior probability."""
        if not self.blocks or not has_letter(text):
            return UNKNOWN, 0.0
        total = np.concatenate([b.totals([text])[0] for b in self.blocks])
        best = int(total.argmax())
        return [x for b in self.blocks for x in b.languages][best], float(1.0 / np.exp(total - total[best]).sum())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that are not learned from: the key's CRC is divisible by ``folds`` (a null key is held out too)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, *, text: str = "text", label: str = "lang") -> Model:
    """A model from all rows of ``docs`` whose text and label are not null."""
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))

    def table(language: str, counts: np.ndarray) -> pa.RecordBatch:
        seen = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([language] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["l", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            of: dict[str, list[str]] = {}
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(language, []).append(text)
            for language, texts in of.items():
                if language not in own and len(own) >= TABLES:  # tables that are full or rare go out early
                    yield from (table(x, own.pop(x)) for x in list(own))
                counts = own.setdefault(language, np.zeros(BUCKETS, np.int64))
                held: list[np.ndarray] = []
                size = 0
                for f in (f for text in texts for f in features(text)):
                    held.append(f)
                    size += len(f)
                    if size >= PIECE:
                        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, size = [], 0
                if held:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield from (table(x, own.pop(x)) for x in list(own))

    with scope(docs.sparkSession):
        return Model(list(_blocks(stored(rows.mapInArrow(releasing(count), "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")), "languages"))))


def _blocks(sums: DataFrame) -> Iterator[Block]:
    """The matrices of (l, bucket, n), in the order of the languages' names."""
    names = [r["l"] for r in sums.select("l").distinct().orderBy("l").toLocalIterator()]
    for at in range(0, len(names), BLOCK):
        own = names[at : at + BLOCK]
        found = sums.where(F.col("l").between(own[0], own[-1])).toArrow()  # at most BLOCK x BUCKETS rows
        matrix = np.ones((BUCKETS, len(own)))  # one of each n-gram beforehand
        column = {x: k for k, x in enumerate(own)}
        place = np.array([column[x] for x in found.column("l").to_pylist()], np.int64)
        matrix[found.column("bucket").to_numpy(), place] += found.column("n").to_numpy()
        yield Block(own, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; the text column is the only input of the prediction."""
    docs = without(docs, ["lang_pred", "score", *STATE])
    names = docs.columns
    schema = extended(docs, names, "__language string, __best double, __all double")
    out = docs.withColumns({"__language": F.lit(None).cast("string"), "__best": F.lit(None).cast("double"), "__all": F.lit(None).cast("double")})
    for number, block in enumerate(model.blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BUCKETS x BLOCK numbers at most

        def make(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = [t if has_letter(t) else None for t in batch.column(names.index(text)).to_pylist()]
            total = shared.value.totals(texts)
            known = np.array([t is not None for t in texts])
            top = total.argmax(axis=1)
            best = total[np.arange(len(texts)), top]
            every = best + np.log(np.exp(total - best[:, None]).sum(axis=1))
            language = [shared.value.languages[k] if ok else None for k, ok in zip(top, known)]
            before = [batch.column(batch.schema.get_field_index(c)) for c in STATE]
            if before[0].null_count < len(texts):  # of an earlier block; ties stay with it
                was, was_every = (c.fill_null(-np.inf).to_numpy(zero_copy_only=False) for c in before[1:])
                stay = was >= best
                language = [old if s else new for old, new, s in zip(before[0].to_pylist(), language, stay)]
                best, every = np.maximum(was, best), np.logaddexp(was_every, every)
            columns = [pa.array(language, pa.string()), *[pa.array(np.where(known, x, np.nan), from_pandas=True) for x in (best, every)]]
            return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], *columns], names=[*names, *STATE])

        out = arrow_map(stored(out, "languages") if number else out, make, schema)
    score = F.when(F.col("__language").isNull(), 0.0).otherwise(F.exp(F.col("__best") - F.col("__all")))
    return out.select(*[f"`{c}`" for c in names], F.coalesce("__language", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
