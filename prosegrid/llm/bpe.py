"""Byte-pair encoding and decoding through an automaton that is compiled from the merges.

Compilation starts from the automaton with one state over the base symbols and applies one merge
gadget per merge (u, v), in order: the state r that u leads to is copied without its v-arc, all
u-arcs are led to the copy, and every state with a u-arc gets an arc uv to where v led from r.
The result is deterministic and reads exactly the correct tokenizations.

Table: all arcs with one label share their target, so the state after a label u is known by u
alone. It has lost the arcs that gadgets (u, v) took from it (one entry a merge: when), and has
the others of the state it began as, which is the one that u's right part led to when u was made.
A label that is younger than a state leads where its left part led. So a transition is decided
by as many look-ups as the two labels have parts, and the table has one entry a merge instead of
states x labels. Decided transitions go into a table of fixed size, a slot for many pairs, so that
common ones are read in one step.

Words are pre-split by the library's own normalizer and pre-tokenizer (ASCII text: by the file's
pattern). Encoding follows the transitions of a pre-split word: exactly one path reads each prefix, so each
position is entered once at most, and a word costs its length times the longest label's. Decoding
emits the labels of the arcs.

The vocabulary file (format of the ``tokenizers`` library; BPE with an end-of-word suffix, NFC,
white space dropped, lower case, byte-level symbols) is a parameter. Its added tokens are matched
in the raw text first, as the library does by default. Texts are cut at ASCII white space, over
which no token, normalization or added token reaches, so each distinct piece is encoded once per
worker (a bounded cache) and very long texts need no special case.

Defined cases: null and empty texts have no tokens and decode to the empty text; input columns
named like an output column are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from prosegrid.llm.base import arrow_map, extended, utf8, without
from prosegrid.llm.cache import Generations, per_worker

END = "\0"  # stands for the end-of-word suffix
#: A worker's tables of known pieces and of known words hold twice so many bytes each; longer pieces are not kept.
TABLE_BYTES, CACHED_BYTES = 20 << 20, 48
MET = 1 << 17  # slots of 8 bytes


class MergeAutomaton:
    """The automaton of correct tokenizations of a merge list."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.labels = list(base)
        self.number = {label: i for i, label in enumerate(base)}
        self.left, self.right = array("i", [-1] * len(base)), array("i", [-1] * len(base))
        self.made = array("i", [-1] * len(base))  # the merge that made the label
        self.met = array("q", [-1]) * MET  # transitions that were decided last, by slot: label pair, then whether there is an arc
        self.lost: dict[int, int] = {}  # (u, v): the merge whose gadget took the v-arc from the state after u
        for step, (u, v) in enumerate(merges):
            if u in self.number and v in self.number:  # else one of them never arises
                self._gadget(step, self.number[u], self.number[v])
        self.longest = max(map(len, self.labels), default=0)
        self.beginnings = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)  # of labels
        for label in self.labels:
            self.beginnings.add_word(label)

    def _gadget(self, step: int, u: int, v: int) -> None:
        label = self.labels[u] + self.labels[v]
        if label in self.number:
            raise ValueError(f"two merges make {label!r}")
        if not self.has_arc(u, v):
            return  # the pair never stands side by side when this merge's turn comes
        self.number[label] = len(self.labels)
        self.labels.append(label)
        self.left.append(u)
        self.right.append(v)
        self.made.append(step)
        self.lost[u << 20 | v] = step

    def has_arc(self, u: int, v: int) -> bool:
        """Whether the state after label ``u`` has an arc with label ``v``."""
        made, lost = self.made, self.lost.get
        when = 1 << 62  # only what was lost before counts
        while True:
            if (step := lost(u << 20 | v)) is not None and step < when:
                return False
            mu, mv = made[u], made[v]
            if mu > mv:
                when, u = mu, self.right[u]
            elif mv >= 0:
                when, v = mv + 1, self.left[v]  # the gadget that made v has passed this state
            else:
                return True

    def walk(self, word: str) -> list[int]:
        """The labels of the one path that reads ``word``; longer labels are tried first.

        Exactly one path reads each prefix, so a position that was left again is never entered twice.
        """
        number, has_arc, longest, n = self.number.get, self.has_arc, self.longest, len(word)
        met = self.met
        begun = self.beginnings.longest_prefix  # no label that starts here is longer
        path: list[int] = []
        starts: list[int] = []  # where each label of the path starts
        left_again: set[int] = set()
        at, end = 0, begun(word[:longest])
        while at < n:
            while end > at:
                label = number(word[at:end])
                if label is not None and end not in left_again:
                    if path:
                        pair = path[-1] << 20 | label
                        slot = path[-1] * 40503 + label & MET - 1
                        if (known := met[slot]) >> 1 != pair:
                            known = met[slot] = pair << 1 | has_arc(path[-1], label)
                        if not known & 1:
                            end -= 1
                            continue
                    path.append(label)
                    starts.append(at)
                    at, end = end, end + begun(word[end : end + longest])
                    break
                end -= 1
            else:
                if not path:
                    raise ValueError(f"no path reads {word!r}")
                left_again.add(at)
                path.pop()
                at, end = starts.pop(), at - 1
        return path


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    own = {b: chr(b) for b in plain}
    return [own.get(b) or chr(next(spare)) for b in range(256)]


class BPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("unk_token") or file["decoder"] or file["post_processor"]:
            raise ValueError("this encoder reads BPE files with an end-of-word suffix and no decoder")
        if [n["type"] for n in file["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this encoder knows NFC, white space and lower case as normalizers")
        own = lambda s: s.removesuffix(suffix) + END if s.endswith(suffix) else s
        if [x["type"] for x in file["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("this encoder knows words split by a pattern, then byte symbols")
        self.ascii_words = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.ASCII)
        library = Tokenizer.from_str(json.dumps(file | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normalize, self.split = library.normalizer, library.pre_tokenizer
        self.symbols = byte_symbols()
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton([*self.symbols, *[c + END for c in self.symbols]], [(own(u), own(v)) for u, v in pairs])
        ids = {own(token): i for token, i in model["vocab"].items()}
        self.coded = [ids[label].to_bytes(4, "little") for label in self.automaton.labels]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens must be matched in the raw text as they are")
        self.added_starts = {t[0] for t in self.added}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.string())
        self._pieces, self._word_ids = Generations(TABLE_BYTES), Generations(TABLE_BYTES)

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids (int32, little-endian) of a piece of text without ASCII white space."""
        text = piece.decode("utf-8", "replace")
        out: list[bytes] = []
        number = self.automaton.number.get
        for part in self.split_added.split(text) if not self.added_starts.isdisjoint(text) else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for word in self._words(part):
                if (label := number(word + END)) is not None:
                    out.append(self.coded[label])
                    continue
                ids = self._word_ids.get(word)
                if ids is None:
                    ids = self._word_ids.old.get(word) or b"".join([self.coded[i] for i in self.automaton.walk(word + END)])
                    if len(word) <= CACHED_BYTES:
                        self._word_ids.put(word, ids)
                out.append(ids)
        return b"".join(out)

    def _words(self, part: str) -> list[str]:
        """The words of a text without added tokens, in byte symbols."""
        if part.isascii() and part.isprintable():  # such bytes are their own symbols
            return self.ascii_words.findall(part.lower())
        # What is a letter or composes with another one depends on the Unicode tables of the library.
        return [word for word, _ in self.split.pre_tokenize_str(self.normalize.normalize_str(part))]

    def _remember(self, piece: bytes) -> bytes:
        ids = self._pieces.old.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
        if len(piece) <= CACHED_BYTES:
            self._pieces.put(piece, ids)
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a whole text (UTF-8) as little-endian int32."""
        known, new = self._pieces.get, self._remember
        return b"".join([known(p) or new(p) for p in (text or b"").split()])

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids: the arcs' labels, joined by a space (such files have no decoder)."""
        ids = pc.fill_null(ids, [])  # a null list is an empty one
        flat = self.tokens.take(ids.flatten())
        offsets = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), " ")


@per_worker
def load(path: str) -> BPE:
    """One encoder per process and file."""
    return BPE(path)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) in the place of the text column.

    ``decoded`` names a further column with the text that the ids decode to, made by the same
    worker, so that a round trip needs the tables of the vocabulary once.
    """
    added = [ids, *([decoded] if decoded else [])]
    docs = without(docs, added)
    rest = [c for c in docs.columns if c != text]
    sent = docs.select(*[f"`{c}`" for c in rest], utf8(text).alias("__text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        found = [bpe.encode(t.as_py()) for t in batch.column(len(rest))]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
        flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists, *([bpe.decode(lists)] if decoded else [])], names=[*rest, *added])

    return arrow_map(sent, make, extended(sent, rest, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")), load)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for."""
    encoded = without(encoded, [text])
    names = encoded.columns

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, load(path).decode(batch.column(names.index(ids)))], names=[*names, text])

    return arrow_map(encoded, make, extended(encoded, names, f"`{text}` string"), load)
