import random
import re
from collections import Counter, defaultdict

import numpy as np

from prosegrid.llm import quality
from pyspark.sql import functions as F


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(lines)


def test_counts_equal_brute_force():
    rng = random.Random(2)
    alphabet = ["a", "b", "c", "é", "漢", " ", " ", "\n", "\t", "\x0b", "\xa0", "\x1c", "#", "|", "<"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 80)))
        assert quality.counts(text.encode()) == brute(text), repr(text)
    assert quality.counts(None) == brute(None)


def test_odd_rows(odd, empty):
    found = quality.judged(odd)
    assert found.count() == odd.count() and quality.judged(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in found.where("doc_id is not null").collect():
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want[:5]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_clashing_columns(odd):
    clash = odd.withColumns({"n_words": F.lit("x"), "kept": F.lit("y"), "symbols": F.lit(1), "__one": F.lit(2)})
    assert quality.judged(clash).count() == odd.count()


def documents(spark):
    rng = random.Random(8)
    rows = []
    for n in range(900):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a")]) if n % 30 else ("fr", "c")
        text = [rng.choice("abcdefgh") * rng.randint(2, 8) for _ in range(rng.randint(50, 150))]
        junk = n % 9 == 0
        if junk:
            text = [w + "$$%" for w in text]
        rows.append((n, " ".join(text), lang, source, int(junk)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk int").repartition(5)


def quantile(values, q):
    ordered = sorted(values)
    return ordered[max(0, int(np.ceil(len(ordered) * q)) - 1)]


def rounded(v):
    """The value that stands for ``v`` in a sketch."""
    g = 1.01 / 0.99
    return 0.0 if v < 1e-4 else 2 * g ** np.ceil(np.log(v) / np.log(g)) / (g + 1)


def test_thresholds_and_verdicts_equal_brute_force(spark):
    rows, df = documents(spark)
    found = {r["doc_id"]: r for r in quality.judged(df).collect()}
    groups, base = defaultdict(list), {n: brute(text) for n, text, *_ in rows}
    for n, _, lang, source, _ in rows:
        for group in ((lang, source), (lang,), ()):
            if not found[n]["base_failed"]:
                groups[group].append(n)
    places = {"symbols": (2, 1), "dup_lines": (3, 5), "repeats": (4, 0), "word_length": (1, 0)}
    for n, _, lang, source, _ in rows:
        kept = not found[n]["base_failed"]
        for feature, (count, over) in places.items():
            value = lambda k: base[k][count] / max(base[k][over], 1)  # noqa: B023, E731
            parts = None
            for group in ((), (lang,), (lang, source)):
                own = np.array([quantile([rounded(value(k)) for k in groups[group]], q) for q in (0.15, 0.5, 0.85)])
                size = len(groups[group])
                parts = own if parts is None else (size * own + 200 * parts) / (size + 200)
            high, low = parts[2] + 16 * (parts[2] - parts[1]), parts[0] - 16 * (parts[1] - parts[0])
            assert abs(found[n][f"high_{feature}"] - high) < 1e-9
            if feature == "word_length":
                assert abs(found[n]["low_word_length"] - low) < 1e-9
                kept &= low <= value(n) <= high
            else:
                most = high * base[n][over]
                kept &= base[n][count] <= most + 3 * np.sqrt(most + 1)
        assert found[n]["kept"] == kept
    junk = {n for n, *_, j in rows if j}
    assert not any(found[n]["kept"] for n in junk if rows[n][2] != "fr")
    assert sum(found[n]["kept"] for n in found if n not in junk) >= 0.97 * (len(rows) - len(junk))


def test_sources_have_thresholds_of_their_own(spark):
    """Two sources with different spreads: the same text is kept in the one and rejected in the other."""
    rng = random.Random(9)
    rows = []
    for n in range(1800):
        words = ["abcd"[: rng.randint(2, 4)] + str(rng.randrange(500)) for _ in range(200)]
        if n % 9 == 1:  # a source of code-like texts
            words = [w + "#" * (rng.random() < 0.3) for w in words]
        rows.append((n, " ".join(words), "en", "code" if n % 9 == 1 else "prose"))
    probe = " ".join(rows[1][1].split())
    rows += [(5000, probe, "en", "prose"), (5001, probe, "en", "code")]
    found = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()}
    assert found[1]["high_symbols"] > found[0]["high_symbols"] + 0.05
    assert found[5001]["kept"] and not found[5000]["kept"]


def test_limits_are_broadcast_and_the_salted_join_is_equal(spark, monkeypatch):
    _, df = documents(spark)
    few = quality.judged(df)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, few.collect())) == sorted(map(str, quality.judged(df).collect()))


def test_sketches_merge_to_the_same(spark):
    _, df = documents(spark)
    measured = quality.base_counts(df.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("text"))).withColumns(quality.ratios())
    parts = measured.randomSplit([0.3, 0.7], 1)
    sketch = lambda d: quality.sketches(d, ["__lang"])
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(quality.merged(sketch(parts[0]).unionAll(sketch(parts[1])), ["__lang"])) == rows(quality.merged(sketch(measured), ["__lang"]))


def test_buckets_are_accurate(spark):
    df = spark.range(1, 3000).select((F.col("id") / 700).alias("v")).withColumn("e", quality.bucket_value(quality.bucket(F.col("v"))))
    assert df.agg(F.max(F.abs(F.col("e") / F.col("v") - 1))).first()[0] <= quality.ACCURACY + 1e-9
