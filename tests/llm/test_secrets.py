import random
import re

from prosegrid.llm import secrets
from pyspark.sql import functions as F

KEYWORD = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
BRUTE = {"assign": KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}


def brute(text):
    out = [(k, m.start(), m.end()) for k, p in BRUTE.items() for m in re.finditer(p, text or "") if LEAST[k](m)]
    return sorted(out, key=lambda s: (s[1], list(BRUTE).index(s[0])))


def texts():
    rng = random.Random(9)
    parts = ["password", "PassWd", "apikey", "API_KEY", "ſecret", "toKen", "secret", "=", ":", " ", '"', "'", "abcdefgh", "short", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "é", "😀", "\n", "-", "."]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(3000)] + ["secret: token: abcdefgh", "x" * 31 + "a" * 32, ""]


def test_fixed_patterns_equal_brute_force():
    for text in texts():
        assert secrets.base_spans(text) == brute(text), repr(text)


def test_odd_rows(odd, empty):
    found = secrets.scan_documents(odd.withColumn("Spans", F.lit(1)))
    assert found.count() == odd.count() and secrets.scan_documents(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in found.where("doc_id is not null").collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_spans"] == secrets.listed(want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in want) for k in BRUTE]
        assert set(r["base_spans"].split(",")) <= {*r["spans"].split(","), ""}


def test_models_tell_classes_apart():
    samples = secrets.labelled_samples()
    held = samples[1::4]
    model = secrets.Markov.train([x for k, x in enumerate(samples) if k % 4 != 1])
    right = [(model.score(t) > secrets.THRESHOLD) == label for t, label in held if len(t) >= secrets.LEAST]
    assert sum(right) / len(right) > 0.97
    prose = ["donaudampfschifffahrtsgesellschaft", "chpfheitschverheiten", "internationalization_2024", "some-very-long-article-title-from-2023", "https://example.org/en/articles/2024/01"]
    assert not any(secrets.looks_random(p, model) for p in prose)
    assert secrets.looks_random("q7Zk1Vx9RtP0mWb3LsYc8NdE", model)


def test_random_strings_are_added_and_base_spans_stay():
    text = "see q7Zk1Vx9RtP0mWb3LsYc8NdE and token = q7Zk1Vx9RtP0mWb3LsYc8NdE"
    base, spans = secrets.scan(text, secrets.default_model())
    assert [s[0] for s in spans] == ["random", "assign"] and set(base) <= set(spans)
    assert text[slice(*spans[0][1:])] == "q7Zk1Vx9RtP0mWb3LsYc8NdE"


def test_redaction_leaves_clean_rows_alone(odd):
    done = {(r["doc_id"], r["text"]) for r in secrets.redact(odd).collect()}
    model = secrets.default_model()
    for r in odd.collect():
        if not secrets.scan(r["text"], model)[1]:
            assert (r["doc_id"], r["text"]) in done
    assert (12, "[SECRET]") in done and (13, "[SECRET]") in done
    assert secrets.redact(odd).columns == odd.columns
