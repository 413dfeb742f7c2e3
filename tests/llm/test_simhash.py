import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegrid.llm import components, simhash
from pyspark.sql import functions as F


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def brute(rows, distance=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    own = set(prints)
    root = classes(own, [(a, b) for a in own for b in own if (a ^ b).bit_count() <= distance])
    least = defaultdict(list)
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[root[p]].append(key)
    return sorted(((key, f"{p:016x}", min(least[root[p]], default=None)) for (key, _), p in zip(rows, prints)), key=str)


def test_odd_rows(odd):
    given_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(found, key=str) == brute(given_rows)


def test_against_brute_force_on_copies(spark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(400):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
        else:
            rows.append((n, " ".join(rng.choices(words, k=rng.randint(3, 120)))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=str) == brute(rows)
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_decides_row_by_row(spark):
    """Repeated rows, and keys that stand in several groups: one row of each group stays."""
    a, b, c = ("one two three four five six seven", "other words in this text here now", "quite another text of seven words again")
    rows = [(3, a), (5, a), (5, b), (2, c), (2, c), (None, a), (None, "alone with no key at all today")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, a), (5, b), (2, c), (None, rows[-1][1])], key=str)


def test_keep_one_keeps_columns(odd):
    kept = simhash.keep_one(odd.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")))
    assert kept.columns == [*odd.columns, "fp", "component_id"]
    assert kept.where("doc_id is null").count() == 0


def test_chunked_groups_lose_no_link(spark):
    """Few partitions and a dense cluster: groups are far over the bound and are cut into pairs of chunks."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    words = {centre}
    while len(words) < 900:
        w = centre
        for b in rng.integers(0, 64, rng.integers(1, 8)):
            w ^= 1 << int(b)
        words.add(w - (1 << 64) if w >> 63 else w)
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    edges = [tuple(r) for r in simhash.links(df, len(words), 4).collect()]
    own = np.array(words, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= 4)
    want, have = classes(range(len(words)), zip(i.tolist(), j.tolist())), classes(words, edges)
    groups = lambda c, key: sorted(sorted(key(n) for n in c if c[n] == r) for r in set(c.values()))
    assert groups(want, lambda n: words[n]) == groups(have, lambda n: n)


def test_three_blocks_find_all(spark, monkeypatch):
    """The choice of blocks for very many fingerprints finds the same links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    words = {int(x) ^ sum(1 << int(b) for b in set(rng.integers(0, 62, 4).tolist())) for x in base for _ in range(6)}
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    few = {tuple(r) for r in components.connected_components(simhash.links(df, len(words), 4)).groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("n")).select(F.concat_ws(",", "n")).collect()}
    many = {tuple(r) for r in components.connected_components(simhash.links(df, 1 << 40, 4)).groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("n")).select(F.concat_ws(",", "n")).collect()}
    assert few == many and few


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1200)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[n] for n in range(201)}) == 1 and len({found[n] for n in range(1000, 1200)}) == 1
    assert found[2000] == found[2001] and len(set(found.values())) == 3


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=80), st.integers(0, 12))
def test_index_finds_all_pairs(words, distance):
    own = np.array(words, np.uint64)
    index = simhash.GrayIndex(own, np.zeros(len(own), np.int64), 1)
    q, found = index.search(own, np.zeros(len(own), np.int64), distance)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if (a ^ b).bit_count() <= distance}
    assert set(zip(q.tolist(), found.tolist())) == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()
