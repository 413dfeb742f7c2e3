import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosegrid.llm import base, bpe, tokencount
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def samples():
    rng = random.Random(1)
    odd = [chr(n) for n in range(0x250)] + list("ΣσςİıẞÅé한국日本　\u200b\u2028😀👍🏽½Ⅳ\x1c\x85") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", " ", "aaaa"]
    out = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(800)]
    return out + ["".join(rng.choices("abcdeinsrt'0A ", k=rng.randint(0, 60))) for _ in range(800)] + ["", " ", "a" * 5000]


def test_automaton_equals_the_library():
    own = bpe.BPE(PATH)
    for text in samples():
        ids = bpe.np.frombuffer(own.encode(text.encode()), "<i4").tolist()
        assert ids == ids_of(text), text
        assert own.decode(bpe.pa.array([ids], bpe.pa.list_(bpe.pa.int32()))).to_pylist() == [LIBRARY.decode(ids, skip_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=4), st.text("abc", min_size=1, max_size=14))
def test_gadgets_equal_merging_in_order(seeds, word):
    """The automaton's only path is what applying the merges one after the other gives."""
    merges, labels = [], ["a", "b", "c"]
    for u, v in seeds:
        left, right = labels[(ord(u) * 7 + len(labels)) % len(labels)], labels[(ord(v) * 5 + len(merges)) % len(labels)]
        if left + right not in labels:
            merges.append((left, right))
            labels.append(left + right)
    own = bpe.MergeAutomaton(["a", "b", "c"], merges)
    parts = list(word)
    for u, v in merges:
        out, at = [], 0
        while at < len(parts):
            if parts[at : at + 2] == [u, v]:
                out.append(u + v)
                at += 2
            else:
                out.append(parts[at])
                at += 1
        parts = out
    assert [own.labels[i] for i in own.walk(word)] == parts


def test_round_trip_of_odd_rows(odd):
    once = bpe.encode(odd, PATH, decoded="decoded")
    twice = bpe.decode(bpe.encode(odd.select("doc_id", "text"), PATH), PATH)
    for r in once.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == ids_of(r["text"])
        assert r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False)
    assert once.count() == twice.count() == odd.count()
    assert once.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    assert bpe.encode(odd.withColumn("IDS", F.lit(1)), PATH).columns == ["doc_id", "lang", "source", "n_chars", "ids"]


def test_bounded_caches(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 1000)
    own = bpe.BPE(PATH)
    for text in samples()[800:1000]:
        assert bpe.np.frombuffer(own.encode(text.encode()), "<i4").tolist() == ids_of(text)
    assert len(own._pieces) <= 7 and len(own._pieces.old) <= 7


def test_long_words_without_a_break():
    rng = random.Random(8)
    word = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)) + "ab" * 3000
    assert bpe.np.frombuffer(bpe.load(PATH).encode(word.encode()), "<i4").tolist() == ids_of(word)


def test_counts_of_odd_rows(odd, empty):
    found = tokencount.token_counts(odd, PATH)
    for r in found.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(ids_of(r["text"])))
    assert found.count() == odd.count()
    assert tokencount.token_counts(empty, PATH).count() == bpe.encode(empty, PATH).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counter_equals_the_library(file):
    path = public_tokenizers.path(file)
    texts = samples()[::7]
    assert tokencount.safe_boundaries(path) == (file == "word_bpe_49k.json")
    counter = tokencount.Counter(path)
    whole = counter.lengths(texts)
    assert counter.count([t.encode() for t in texts]) == whole
    assert counter.count([None, b""]) == [0, 0]


def test_batches_are_balanced():
    pieces = [b"x" * n for n in (3, 4, 5, 100, 1, 1)]
    assert [list(map(len, b)) for b in tokencount.balanced(pieces, 8)] == [[3, 4], [5], [100], [1, 1]]


def test_workers_keep_the_tables_of_one_operator():
    bpe.load(PATH), tokencount.load(PATH)
    list(base.releasing(iter, bpe.load)([]))
    assert (bpe.load.cache_info().currsize, tokencount.load.cache_info().currsize) == (1, 0)
    list(base.releasing(iter)([]))
    assert bpe.load.cache_info().currsize == 0
