import random
import re
from collections import Counter

from prosegrid.llm import decontam
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        item = words(item)
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == item[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add("" if name is None else str(name))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(40)] + ["Été", "x"]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 12, 13, 14, 40])))) for n in range(30)] + [(3, "same id again w1 w2 w3"), (None, "no id here at all"), (99, None)]
    docs = []
    for n in range(150):
        text = rng.choices(vocabulary, k=rng.randint(0, 200))
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((n, rng.choice([" ", ", ", "-"]).join(text)))
    return docs + [(500, None), (501, ""), (502, items[4][1]), (502, items[4][1])], items


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, *brute(t, items)) for d, t in docs)
    for block in (decontam.BLOCK_WORDS, 60):  # one block, and many
        found = decontam.contamination(df, benchmark, block_words=block)
        have = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect())
        assert have == want
        assert all(r["n_items"] == len(r["items"]) for r in found.collect())
    kept = decontam.decontaminate(df.withColumn("n_hit", F.lit("mine")), benchmark)
    assert kept.columns == ["doc_id", "text", "n_hit"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[4])


def test_stored_index(spark, tmp_path):
    """The index is a table of the posting lists of all terms; searching the stored table finds the same."""
    docs, items = corpus()
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(docs)], "k long, doc_id long, text string").repartition(3)
    decontam.build_index(df, segment_words=500).write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    placed = {(r["segment"], p): r for r in index.where("term is null").collect() for p in range(r["first"], r["first"] + r["n_words"])}
    have = {}
    for r in index.where("term is not null").collect():
        own = decontam.np.frombuffer(r["positions"], "<i4").tolist()
        assert own == sorted(own) and len(own) == r["n"]
        for p in own:
            d = placed[r["segment"], p]
            have[d["own"]["k"], p - d["first"]] = bytes(r["term"]).decode()
    assert have == {(k, p): w for k, (_, t) in enumerate(docs) for p, w in enumerate(words(t))}
    assert index.select("segment").distinct().count() > 10
    found = decontam.contamination_by(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["k"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()) == sorted((k, *brute(t, items)) for k, (_, t) in enumerate(docs))


def test_the_search_reads_the_stored_index(spark):
    """No document is read again: hits come from the lists of the written table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    index = decontam.stored(decontam.build_index(docs), "index")
    found = decontam.contamination_by(index, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "positions" in plan and "index-" in plan and "documents.parquet" not in plan
    assert found.where("contaminated").count() > 0


def test_small_candidate_blocks(monkeypatch):
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    docs, items = corpus()
    phrases = decontam.Phrases.of([("" if i is None else str(i), decontam.words_of((t or "").encode())) for i, t in items])
    index = decontam.PositionalIndex.of_words([decontam.words_of((t or "").encode()) for _, t in docs], phrases.terms)
    for rarity in (index.counts, -index.counts):  # any order of intersection finds the same
        hits, found = decontam.search(index, phrases, rarity)
        for (_, text), h, f in zip(docs, hits, found):
            assert (len(h), sorted(f)) == brute(text, items)[1:3]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = [(1, "seven old wizards quietly mix"), (2, "word5")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    none = benchmark.limit(0)
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.contamination(odd, benchmark).collect())
    assert len(have) == odd.count()
    short = [(str(r["doc_id"]), *brute(r["text"], items)) for r in odd.collect() if len(r["text"] or "") < 1000]
    assert all(s in have for s in short)
    assert decontam.contamination(odd, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.contamination(empty, benchmark).count() == 0


def test_proximity():
    terms = {b"a": 0, b"b": 1, b"c": 2}
    index = decontam.PositionalIndex.of_words([b"a x b x x c".split(), b"b a".split(), b"c".split()], terms)
    at = lambda words, span: index.proximity(decontam.np.array([terms[w] for w in words]), span, index.counts).tolist()
    assert at([b"a", b"b"], 1) == [8] and at([b"a", b"b"], 2) == [0, 8]
    assert at([b"a", b"c"], 4) == [] and at([b"a", b"c"], 5) == [0]
    assert at([b"b", b"c"], 2) == []


def test_proximity_over_the_stored_index(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "k long, text string").repartition(3)
    asked = [("p", "w1 w2 w3"), ("q", "x W7"), ("none", "w1 nowhere")]
    counts = Counter(w for _, t in docs for w in words(t))
    want = []
    for name, text in asked:
        own = set(words(text))
        rare = [w for w in own if counts[w] == min(counts[x] for x in own)]
        assert len(rare) == 1
        for k, (_, t) in enumerate(docs):
            found = words(t)
            want += [(k, name, p) for p, w in enumerate(found) if w == rare[0] and own <= set(found[max(0, p - 6) : p + 7])]
    have = decontam.proximity(decontam.stored(decontam.build_index(df, segment_words=700), "index"), asked, 6)
    assert sorted(map(tuple, have.collect())) == sorted(want) and want
