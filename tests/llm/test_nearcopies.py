import random

import corpus_pipeline
import numpy as np

from prosegrid.llm import nearcopies

VOCABULARY = [f"w{n}" for n in range(400)]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, similarity=0.8):
    """The smallest key of each class of (key, text) under exact Jaccard links."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= similarity * len(x | sets[j]) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(k for r, (k, _) in zip(root, rows) if r == c) for c in set(root))


def copies(seed=3, families=40):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = rng.choices(VOCABULARY, k=rng.randint(8, 160))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_stage_keeps_one_of_copies_at_eight_tenths(spark):
    rows = copies() + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == brute(rows)


def test_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", 150)
    rows = copies(seed=4, families=15)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(df).collect()) == brute(rows)


def test_bands_find_pairs_at_the_least_similarity():
    rng = np.random.default_rng(5)
    for _ in range(300):
        own = rng.integers(0, 1 << 64, 450, np.uint64)  # 400 of 500 shared
        x, y = np.unique(own[:450]), np.unique(np.concatenate([own[:400], rng.integers(0, 1 << 64, 50, np.uint64)]))
        assert len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
        assert set(nearcopies.band_values(x)) & set(nearcopies.band_values(y))


def test_index_finds_pairs_at_the_least_similarity():
    """The wide search of the Gray-ordered index loses no pair of 0.8, neither of long nor of short texts."""
    rng = np.random.default_rng(6)
    for n in (5, 10, 50, 500):
        for _ in range(150):
            own = rng.integers(0, 1 << 64, n, np.uint64)
            x, y = np.unique(own), np.unique(own[: -(-4 * n // 5)])  # 4 of 5 are left
            prints = np.array([nearcopies.simhash(s) for s in (x, y)], np.uint64)
            assert nearcopies.forest([x, y], prints, np.zeros(2, np.int64), False, 0.8) == [(0, 1)]


def test_odd_rows(odd, empty):
    kept = nearcopies.keep_one(odd)
    assert kept.columns == odd.columns and nearcopies.keep_one(empty).count() == 0
    assert kept.where("doc_id is null").count() == 0 and kept.groupBy("doc_id").count().where("count > 1").count() == 0


def test_deal_is_by_simhash_bits():
    """What brings texts together is cut from SimHash fingerprints; the first word is that of ``simhash``."""
    rng = np.random.default_rng(7)
    for n in (1, 5, 300, 2000):
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        first = nearcopies.simhash(own)
        assert [v & 511 for v in nearcopies.band_values(own)[:7]] == [first >> 9 * k & 511 for k in range(7)]
    assert nearcopies.band_values(own[:0]) == []


def test_long_fingerprints_are_all_linked():
    """Classes of the block index against all pairs, within a chunk and between two chunks."""
    rng = np.random.default_rng(8)
    words = np.repeat(rng.integers(0, 1 << 64, (300, nearcopies.WORDS), np.uint64), 4, axis=0)
    for _ in range(3):  # one bit in eight
        noise = rng.integers(0, 1 << 64, (3, *words.shape), np.uint64)
        words[rng.permutation(len(words))[:900]] ^= (noise[0] & noise[1] & noise[2])[:900]
        side = rng.integers(0, 2, len(words))
        for cross in (False, True):
            found = nearcopies.near_prints(words, side, cross, pairs_at_once=500, joined_at_once=50)
            near = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= 100
            x, y = np.nonzero(near & (side[:, None] != side[None]) if cross else near)
            assert (found[x] == found[y]).all()
            far = np.bitwise_count(words ^ words[found]).sum(axis=1)
            assert (far <= 512 // 2 - 40).all()


def test_pairs_of_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PRINTS", 25)
    rows = copies(seed=9, families=40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(df).collect()) == brute(rows)
