import pytest

from prosegrid.plans import registry

LONG = "plain words " * 60 + "the food is a terrible horrible disaster"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", LONG), (2, 1, "user", "x" * 507 + " food")], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, LONG, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def test_registered_analyzers_see_whole_texts(spark, folder, monkeypatch):
    rows = lambda name: registry.QUERIES[name](spark, folder).collect()
    assert {r["processed_text"] for r in rows("analyze_translate")} == {LONG.replace("the ", "le "), "x" * 507 + " food"}
    scores = {(r["payload_id"], r["label"]): r["score"] for r in rows("analyze_zero_shot")}
    assert scores["1-1", "food"] > 0.9 and scores["2-1", "food"] > 0.9
    sentiment = {r["label"]: r["score"] for r in rows("analyze_zero_shot_sentiment") if r["payload_id"] == "1-1"}
    assert sentiment["negative"] > sentiment["positive"]
    chunks = {(r["payload_id"], r["label"]): r["score"] for r in rows("analyze_split_and_aggregate")}
    assert chunks["2-1", "food"] > 0.9
    seen = []
    monkeypatch.setattr(registry.analyze, "predicted", lambda *a, real=registry.analyze.predicted: seen.append(a[4]) or real(*a))
    assert rows("analyze_classify") and seen == [None]
