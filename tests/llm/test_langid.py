import re
from collections import Counter
from zlib import crc32

import numpy as np

from prosegrid.llm import langid
from pyspark.sql import functions as F

TEXTS = {"en": "the cat sat on the mat with this other thing", "de": "der hund und die katze schlafen nicht über nacht", "fr": "le chat est assis près de la fenêtre où"}


def train(spark):
    rows = [(n, TEXTS[k], k) for n, k in enumerate(list(TEXTS) * 5)] + [(100, None, "en"), (101, "x", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))


def test_model_equals_brute_force(spark):
    model = train(spark)
    (block,) = model.blocks
    assert block.languages == ["de", "en", "fr"]
    counts = np.ones((langid.BUCKETS, 3))
    for k, language in enumerate(block.languages):
        for f in langid.features(TEXTS[language]):
            np.add.at(counts[:, k], f, 5)
    want = np.log(counts / counts.sum(axis=0))
    assert np.allclose(block.log_probability, want, atol=1e-5)
    text = "die katze"
    total = sum(want[f].sum(axis=0) for f in langid.features(text))
    best, score = model.predict(text)
    assert best == block.languages[int(total.argmax())] == "de"
    assert abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-4


def brute_grams(text):
    """The n-grams of a text as strings, without the module's code."""
    blank = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    blank = re.sub(" +", " ", blank)
    return Counter(blank[i : i + n] for n in (1, 2, 3) for i in range(len(blank) - n + 1))


def test_counts_equal_brute_force():
    for text in ["The cat, the CAT.", "a", "über 12 Straße!", "", "x" * 500]:
        grams = brute_grams(text)
        own = Counter()
        for gram, n in grams.items():
            mixed = len(gram)
            for c, m in zip(gram, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                mixed = ((mixed ^ ord(c)) * m) & 0xFFFFFFFF
                mixed ^= mixed >> 15
            own[mixed % langid.BUCKETS] += n
        counts = langid.bucket_counts([None, text])
        assert not counts[0].any() and {int(k): int(counts[1][k]) for k in np.flatnonzero(counts[1])} == dict(own)


def test_query_equals_brute_force(spark):
    """The registered query on a whole table, against log probabilities summed row by row."""
    from prosegrid.llm import queries

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    learned = [r for r in docs if crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]
    names = sorted({r["lang"] for r in learned})
    counts = np.ones((langid.BUCKETS, len(names)))
    for r in learned:
        counts[:, names.index(r["lang"])] += langid.bucket_counts([r["text"]])[0]
    logs = np.log(counts / counts.sum(axis=0))
    found = {r["doc_id"]: r for r in queries.op5_language_id(spark, data).collect()}
    assert len(found) == len(docs)
    for r in docs:
        total = langid.bucket_counts([r["text"]])[0] @ logs
        own = found[r["doc_id"]]
        assert own["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert own["lang_pred"] == names[int(total.argmax())]
        assert abs(own["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-3


def test_blocks_of_languages_change_nothing(spark, monkeypatch, odd):
    """More languages than one matrix holds: further passes, the same verdicts."""
    rows = [(n, f"{TEXTS[k]} w{n % 9}", f"{k}{n % 7}") for n, k in enumerate(list(TEXTS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = langid.train(docs)
    monkeypatch.setattr(langid, "BLOCK", 4)
    monkeypatch.setattr(langid, "TABLES", 3)
    cut = langid.train(docs)
    assert len(whole.blocks) == 1 and len(cut.blocks) == 6
    a, b = ([(str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in sorted(langid.identify(odd, m).collect(), key=str)] for m in (whole, cut))
    assert a == b


def test_pieces_cover_every_ngram(monkeypatch):
    whole = np.sort(np.concatenate(list(langid.features("abc déf " * 50))))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (np.sort(np.concatenate(list(langid.features("abc déf " * 50)))) == whole).all()


def test_odd_rows(spark, odd, empty):
    model = train(spark)
    found = langid.identify(odd.withColumn("SCORE", F.lit("x")), model)
    assert found.columns == [*odd.columns, "lang_pred", "score"] and found.count() == odd.count()
    for r in found.collect():
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == langid.UNKNOWN) == (not letters)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in (*TEXTS, langid.UNKNOWN)
    assert langid.identify(empty, model).count() == 0


def test_nothing_learned(odd, empty):
    model = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {langid.UNKNOWN}


def test_held_out_by_the_ids_crc(spark):
    rows = spark.range(500).select(F.col("id"), langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(langid.held_out(F.lit(None))).first()[0] is True


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    found = langid.identify(docs.where("held_out"), model).where("lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found > 0.98
