"""Scalar functions against values worked out by hand."""

from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegrid.functions import cleaning, devices, hashing, html, pii, render, sentiment, stem, times
from prosegrid.functions.tokens import sentences, white_space_tokens, word_tokens
from pyspark.sql import functions as F


def run(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_word_tokens(spark):
    found = run(spark, word_tokens, "It’s fine... really???", "He left. They (all) stayed.", "Mr. Fox can't pay $5,000.", None, "")
    assert found[0] == ["It", "’", "s", "fine", "...", "really", "?", "?", "?"]
    assert found[1] == ["He", "left", ".", "They", "(", "all", ")", "stayed", "."]
    assert found[2] == ["Mr.", "Fox", "ca", "n't", "pay", "$", "5,000", "."]
    assert found[3:] == [None, []]


def test_sentences(spark):
    assert run(spark, sentences, "One is “there.” Two came! 3 left? no")[0] == ["One is “there.”", "Two came!", "3 left? no"]
    assert run(spark, sentences, "One here. Two there! Three?")[0] == ["One here.", "Two there!", "Three?"]
    assert run(spark, sentences, "He met Dr. Who. Then left.")[0] == ["He met Dr. Who.", "Then left."]


@pytest.mark.parametrize(
    ("step", "text", "expected"),
    [
        (cleaning.lower_case(), "ABC Déf", "abc déf"),
        (cleaning.white_space(), " a \u00a0 b ", "a b"),
        (cleaning.punctuation(), "a, !! b.c", "a bc"),
        (cleaning.special_characters(), "a# @ b&1", "a b1"),
        (cleaning.stop_words(["in", "the"]), "In the end in", "In end"),
        (cleaning.domain_keywords([("new york", "NY"), ("NY city", "NYC")]), "a new york city", "a NYC"),
        (cleaning.substitute("-", " "), "a-b c", "a b c"),
        (cleaning.substitute(r"(\w)(\d)", r"\2\1"), "a1 b2", "1a 2b"),
        (cleaning.substitute("x", ""), "axb", "ab"),
        (cleaning.substitute("x", None), "axb", "axb"),
        (cleaning.decode_unicode(), "ﬁne café ½", "fine cafe 12"),
        (cleaning.stemming(), "running flies happily", "run fli happili"),
        (cleaning.stemming(None), "running", "running"),
        (cleaning.lemmatization({"was": "be"}.get), "was", "be"),
        (cleaning.date_time(), "Meet on 3 May 2020 at noon", "Meet on at noon"),
        (cleaning.date_time(), "nothing here", "nothing here"),
    ],
)
def test_cleaning(spark, step, text, expected):
    assert run(spark, lambda t: F.array_join(step(white_space_tokens(t)), " "), text)[0] == expected


def test_default_chain_puts_stop_words_after_stemming(spark):
    found = run(spark, lambda t: F.array_join(cleaning.default_chain(stop=["run"])(white_space_tokens(t)), " "), "The Running man’s café!!", None, "")
    assert found == ["the man caf", None, ""]  # special characters go before Unicode is decoded


def test_porter_published_examples():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit triplicate triplic hopefulness hope formalize formal revival reviv adjustable adjust replacement replac adoption adopt probate probat rate rate controll control roll roll"
    words = pairs.split()
    assert [stem.porter(w) for w in words[::2]] == words[1::2]


def test_murmur3_known_values():
    assert hashing.murmur3(b"") == 0
    assert hashing.murmur3(b"", 1) == 0x514E28B7
    assert hashing.murmur3(b"test") == 0xBA6BD213
    assert hashing.murmur3(b"Hello, world!") == 0xC0363E43
    assert hashing.hex_id("test") == "ba6bd213"


def test_visible_text():
    page = "<html><head><title>T</title></head><body><p> a </p><script>x()</script><style>p{}</style><!-- c --><div>b<br>c</div></body></html>"
    assert html.visible_text(page) == "a b c"
    assert html.visible_text(None) is None
    assert html.article("<html lang='en'><head><title>T</title></head><nav><p>menu</p></nav><p>one</p><p>two</p></html>")["text"] == "one\ntwo"
    assert html.article("") is None


def test_flatten_and_json():
    value = {"a": {"b": 0.125, "c": [{"d": 1}, {"d": 2}]}, "e": ["x", "é"], "f": 2.675, "g": []}
    assert render.flatten(value) == {"a_b": "0.12", "a_c_d": 2, "e": '["x", "é"]', "f": "2.67", "g": "[]"}
    assert render.to_json_bytes(None) is None
    assert render.to_json({"t": datetime(2024, 1, 2, tzinfo=timezone.utc), "x": "é"}) == '{"t": "2024-01-02T00:00:00+00:00", "x": "é"}'


def test_bullets():
    assert render.bullets({"a": "x", "b": {"c": 1}, "d": ["y"]}, quote=("<", ">")) == "* a:\n<x>\n* b\n** c: 1\n* d\n**:\n<y>"
    assert render.bullets("x") == "*: x"


def test_times():
    now = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
    assert times.parse_time("2m", now).minute == 58
    assert times.parse_time("1M", now) == datetime(2024, 2, 29, 12, tzinfo=timezone.utc)
    assert times.parse_time("2Y", now).year == 2022
    assert times.parse_time("2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert times.parse_time("202401020304") == datetime(2024, 1, 2, 3, 4, tzinfo=timezone.utc)
    assert times.parse_time("2024-01-02") == datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert times.epoch("1970-01-02") == 86400
    assert times.epoch("no time at all") is None
    with pytest.raises(ValueError):
        times.parse_time("2x", now)


def test_sentiment():
    assert sentiment.compound("good") > 0 > sentiment.compound("not good")
    assert sentiment.compound("very good") > sentiment.compound("good") > sentiment.compound("slightly good")
    assert sentiment.compound("it is GOOD today") > sentiment.compound("it is good today")
    assert sentiment.compound("good but terrible") < 0
    assert sentiment.compound("good!!!") > sentiment.compound("good")
    assert sentiment.compound(None) == sentiment.compound("") == 0


def test_neutral_is_wholly_negative(spark):
    assert run(spark, lambda t: sentiment.two_sided(sentiment.lexicon_compound(t)), "nothing known", "bad")[0] == {"positive": 0.0, "negative": 1.0}


def test_pii():
    text = "Mail bob@example.com or 10.0.0.1, not 999.1.1.1; card 4111 1111 1111 1111"
    spans = pii.recognize(text, pii.default_recognizers())
    assert [(s[0], text[s[1] : s[2]]) for s in spans] == [("EMAIL_ADDRESS", "bob@example.com"), ("IP_ADDRESS", "10.0.0.1"), ("CREDIT_CARD", "4111 1111 1111 1111")]
    new, items = pii.anonymize(text, spans, {"IP_ADDRESS": pii.Operator("mask", {"chars_to_mask": 4}), "CREDIT_CARD": pii.Operator("redact")})
    assert new == "Mail <EMAIL_ADDRESS> or 10.0****, not 999.1.1.1; card "
    assert [new[i[1] : i[2]] for i in items] == ["<EMAIL_ADDRESS>", "10.0****", ""]


def test_devices():
    assert devices.device_id("cpu") == -1
    assert devices.device_id("cuda:3") == 3
    with pytest.raises(ValueError):
        devices.device_id("tpu")


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_stems_never_grow(word):
    assert len(stem.porter(word)) <= len(word.lower()) + 1
