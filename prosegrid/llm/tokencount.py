"""Token counts: the library's batch encoding in Arrow functions that hand back lengths only.

Texts are cut at safe boundaries: the tokenizers' pre-tokenizers drop white space and neither
words, normalization nor added tokens reach over it, so the counts of the pieces between ASCII
white space add up to the count of the whole text (``safe_boundaries`` says for which files this
is known to hold; other files are encoded as whole texts). Each distinct piece is encoded once per
worker; new pieces go to the library in batches of about equal bytes. A very long text is many
short pieces, so no call grows with a document.

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside a
text count as the library's default has it; an empty table gives no rows; input columns named
like an output column are dropped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, extended, utf8, without
from prosegrid.llm.cache import Generations, per_worker

BATCH_BYTES = 1 << 18
#: The table of known pieces holds twice so many bytes; longer pieces are not kept.
TABLE_BYTES, CACHED_BYTES = 32 << 20, 48


def safe_boundaries(path: str) -> bool:
    """Whether ASCII white space separates tokens of this file in every context."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    level = [s for s in steps if s["type"] == "ByteLevel"]
    normal = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    spaces = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
    return bool(split) and r"\s" in split[0]["pattern"].get("Regex", "") and not any(s["add_prefix_space"] for s in level) and set(normal) <= {"NFC", "Replace", "Lowercase"} and not spaces


def balanced(pieces: list[bytes], most: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """The pieces in their order, in batches of at most ``most`` bytes (a longer piece alone)."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        if held and size + len(piece) > most:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece)
    if held:
        yield held


class Counter:
    """Counts tokens with the library of one vocabulary file."""

    def __init__(self, path: str):
        self.safe = safe_boundaries(path)
        self.lengths = self._library(path)
        self.known = Generations(TABLE_BYTES)

    @staticmethod
    def _library(path: str) -> Callable[[list[str]], list[int]]:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> Iterator[tuple[bytes, int]]:
        for batch in balanced(pieces):
            yield from zip(batch, self.lengths([p.decode("utf-8", "replace") for p in batch]))

    def count(self, texts: list[bytes | None]) -> list[int]:
        if not self.safe:
            held = {t: 0 for t in texts if t}
            held.update(self._encode(list(held)))
            return [held[t] if t else 0 for t in texts]
        out = []
        known = self.known
        for text in texts:
            pieces = (text or b"").split()
            found = [known.get(p) for p in pieces]
            if None in found:
                own: dict[bytes, int] = {}
                for p, n in zip(pieces, found):
                    if n is None and (n := known.old.get(p)) is not None:
                        known.put(p, n)
                        own[p] = n
                own.update(self._encode([p for p, n in dict(zip(pieces, found)).items() if n is None and p not in own]))
                for p, n in own.items():
                    if len(p) <= CACHED_BYTES and p not in known:
                        known.put(p, n)
                found = [own[p] if n is None else n for p, n in zip(pieces, found)]
            out.append(sum(found))
        return out


@per_worker
def load(path: str) -> Counter:
    """One counter per process and file."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens in the place of the text column."""
    docs = without(docs, ["n_bytes", "n_tokens"])
    rest = [c for c in docs.columns if c != text]
    sent = docs.select(*[f"`{c}`" for c in rest], F.coalesce(utf8(text), F.lit(b"")).alias("__text"))
    schema = extended(sent, rest, "n_bytes long, n_tokens long")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(rest)).to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes), pa.array(load(path).count(texts), pa.int64())], names=[*rest, "n_bytes", "n_tokens"])

    return arrow_map(sent, make, schema, load)
