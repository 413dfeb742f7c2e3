"""Payload operators: splitting, analysis, aggregation, sinks, state, streams."""

import json
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegrid import config as configuration
from prosegrid.functions import cleaning, pii
from prosegrid.functions.tokens import white_space_tokens
from prosegrid.operators import aggregate, analyze, clean, split
from prosegrid.pipeline import Pipeline
from prosegrid.schema import payload, with_segment
from prosegrid.sinks import convert, deliver
from prosegrid.sources import cursor, frames, mail, media, polling, reviews, social, web
from prosegrid.state import Conflict, Workflow, WorkflowStore


def payloads(spark, *texts, source="sample"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return payload(rows, F.col("t"), F.col("i"), meta=F.struct(F.col("i").alias("n")), source_name=source)


def test_chunks_by_hand():
    assert split.chunks("aaa bb cccc d", 6) == ["aaa bb", "cccc d"]
    assert split.chunks("aaa bb cccc d", 5) == ["aaa", "bb", "cccc", "d"]
    assert split.chunks("abcdefgh ij", 3) == ["abc", "def", "gh", "ij"]
    assert split.chunks("", 3) == []
    assert split.chunks("ab cd ef gh", 6, 4) == ["ab cd", "cd ef", "ef gh"]


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\t", max_size=60), st.integers(1, 12), st.integers(0, 15))
def test_chunks_end_and_cover(text, limit, stride):
    found = split.chunks(text, limit, stride)
    assert all(0 < len(c) <= limit for c in found)
    if stride == 0:
        assert "".join("".join(found).split()) == "".join(text.split())
    else:
        assert all(c in text for c in found)


def test_split_numbers_chunks(spark):
    rows = split.split(payloads(spark, "aa bb\ncc dd", "", None, "x"), split.SplitterConfig(5, document_id_key="n", honor_paragraph_boundary=True, paragraph_marker="\n"))
    found = [tuple(r) for r in rows.select("splitter.document_id", "splitter.chunk_id", "splitter.total_chunks", "splitter.phrase", "splitter.chunk_length").orderBy("document_id", "chunk_id").collect()]
    assert found == [("0", 0, 2, "aa bb", 5), ("0", 1, 2, "cc dd", 5), ("3", 0, 1, "x", 1)]


def scored(spark):
    rows = spark.createDataFrame([("d", 0, "a" * 10, {"a": 0.8}), ("d", 1, "b" * 30, {"a": 0.4, "b": 1.0}), ("e", 0, "c", {"a": 0.5})], "doc string, n int, t string, s map<string,double>")
    made = payload(rows, F.col("t"), F.col("doc"), meta=F.struct("doc", "n", "s"))
    made = made.withColumn("splitter", F.struct(F.col("processed_text").alias("phrase"), F.col("meta.n").alias("chunk_id"), F.length("processed_text").alias("chunk_length"), F.col("meta.doc").alias("document_id"), F.lit(2).alias("total_chunks")))
    return with_segment(made, "classifier_data", F.col("meta.s"))


def test_average_score(spark):
    rows = {r["payload_id"]: r for r in aggregate.aggregate(scored(spark)).collect()}
    data = rows["d"]["segmented_data"]["aggregator_data"]
    assert data["avg_score"] == pytest.approx({"a": 0.5, "b": 0.75})
    assert data["aggregator_name"] == "ClassificationAverageScore"
    assert rows["d"]["processed_text"] == "a" * 10 + " " + "b" * 30
    assert rows["d"]["segmented_data"]["classifier_data"] is None


def test_max_categories_is_strict(spark):
    rows = {r["payload_id"]: r["segmented_data"]["aggregator_data"] for r in aggregate.aggregate(scored(spark), aggregate.MaxCategories(0.5)).collect()}
    assert rows["d"]["category_count"] == {"a": 1, "b": 1}
    assert rows["d"]["max_scores"] == {"a": 0.8, "b": 1.0}
    assert rows["e"]["category_count"] == {}


def test_unclassified_documents_pass(spark):
    rows = aggregate.aggregate(payloads(spark, "x", "y")).collect()
    assert sorted(r["processed_text"] for r in rows) == ["x", "y"]
    assert all(r["segmented_data"]["aggregator_data"] is None for r in rows)


def test_existing_result_wins(spark):
    twice = analyze.dummy(analyze.dummy(payloads(spark, "x"), "one"), "two")
    assert twice.first()["segmented_data"]["dummy_data"] == "one"


def test_zero_shot_keeps_the_callers_labels(spark):
    labels = ["food"]
    config = analyze.ClassifierConfig(labels=labels)
    found = analyze.zero_shot(payloads(spark, "food was good", None), config).select("segmented_data.classifier_data").collect()
    assert labels == ["food"] and all(set(r[0]) == {"food", "positive", "negative"} for r in found)
    with pytest.raises(ValueError):
        analyze.zero_shot(payloads(spark, "x"), analyze.ClassifierConfig())


def test_splitter_is_required():
    with pytest.raises(ValueError):
        analyze.AnalyzerConfig(use_splitter_and_aggregator=True)


def test_split_and_aggregate_keeps_documents(spark):
    config = analyze.ClassifierConfig(True, split.SplitterConfig(8), labels=["food"])
    assert analyze.zero_shot(payloads(spark, "food is good here", "bad"), config).count() == 2


@pytest.mark.parametrize(("only", "replace", "text"), [(False, True, "<EMAIL_ADDRESS>"), (False, False, "a@b.org"), (True, True, "a@b.org")])
def test_personal_data_modes(spark, only, replace, text):
    row = analyze.personal_data(payloads(spark, "a@b.org"), analyze.PIIConfig(analyze_only=only, replace_original_text=replace)).first()
    assert row["processed_text"] == text
    assert len(row["segmented_data"]["pii_data"]["analyzer_result"]) == 1
    assert (row["segmented_data"]["pii_data"]["anonymized_text"] is None) == only


def test_analyzer_operators_apply_without_config_operators(spark):
    row = analyze.personal_data(payloads(spark, "a@b.org"), analyze.PIIConfig(), anonymizers={"DEFAULT": pii.Operator("replace", {"new_value": "X"})}).first()
    assert row["processed_text"] == "X"


def test_translation_keeps_the_original(spark):
    row = analyze.translate(payloads(spark, "the cat"), analyze.dictionary_translator({"the": "le"})).first()
    assert (row["processed_text"], row["segmented_data"]["translation_data"]["original_text"]) == ("le cat", "the cat")


def test_clean_operator(spark):
    config = clean.CleanerConfig([cleaning.lower_case(), cleaning.punctuation()], white_space_tokens)
    assert [r["processed_text"] for r in clean.clean(payloads(spark, "A, b!", None, ""), config).orderBy("payload_id").collect()] == ["a b", None, ""]


def test_frame_source_skips_nulls_and_checks_columns(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, z int")
    row = frames.from_frame(df, ["x", "y", "z"], include_columns=["z"]).first()
    assert row["processed_text"] == "a 1" and row["meta"].asDict() == {"z": 1}
    with pytest.raises(ValueError):
        frames.from_frame(df, [])
    with pytest.raises(ValueError):
        frames.from_frame(df, ["w"])


def test_query_string():
    assert social.query_string(social.SearchConfig(keywords=["a", "b"], hashtags=["#c"])) == "(a OR b) OR (#c) (-is:reply -is:retweet)"
    assert social.query_string(social.SearchConfig(query="q")) == "q"
    assert social.SearchConfig(query="q", max_results=500).max_results == 100
    with pytest.raises(ValueError):
        social.SearchConfig()


def test_app_addresses(spark):
    assert reviews.app_address("https://apps.example.com/us/app/some-name/id123") == ("us", "some-name", "123")
    assert reviews.package_address("https://p.example.com/d?id=a.b&gl=us&gl=fr&hl=en") == ("a.b", ["us", "fr"], "en")
    with pytest.raises(ValueError):
        reviews.app_address("https://apps.example.com/us")
    assert reviews.search_app_id("x", lambda q: "... /id987 ...") == "987"
    with pytest.raises(RuntimeError):
        reviews.search_package("x", lambda q: "nothing")


def test_cursor_moves_forward_only(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    records = spark.createDataFrame([("a", "1", at(1)), ("a", "2", at(3)), ("b", "3", at(2)), ("c", "4", None)], "key string, id string, ts timestamp")
    cursors = cursor.advance(records)
    assert {r["key"]: r["since_id"] for r in cursors.collect()} == {"a": "2", "b": "3"}
    later = spark.createDataFrame([("a", "0", at(1)), ("a", "5", at(4)), ("d", "6", at(0))], "key string, id string, ts timestamp")
    assert sorted(r["id"] for r in cursor.newer(later, cursors, datetime(2023, 1, 1, tzinfo=timezone.utc), record_id="id").collect()) == ["5", "6"]
    assert {r["key"]: r["since_id"] for r in cursor.advance(later, cursors).collect()} == {"a": "5", "b": "3", "d": "6"}


def test_polled_pages_stop():
    pages = {None: ([{"id": 3, "ts": 30}, {"id": 2, "ts": 20}], "x"), "x": ([{"id": 1, "ts": 10}], None)}
    service = lambda request, token: pages[token]
    assert [r["id"] for r in polling.pages(service, {}, 10, None)] == [3, 2]
    assert [r["id"] for r in polling.pages(service, {}, 0, 1)] == [3]


def test_mail():
    raw = b"Subject: =?utf-8?b?SMOp?=\r\nFrom: a@b.c\r\nTo: d@e.f\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nMessage-ID: <1>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>rich</p><script>x</script>\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nhidden\r\n--B--\r\n"
    found = mail.parse_message(raw)
    assert found["subject"] == "Hé" and found["date_received"].hour == 9
    assert found["content"].split() == ["plain", "rich"]


def test_mail_rows(spark):
    raw = b"Subject: S\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1>\r\n\r\nbody"
    rows = spark.createDataFrame([("INBOX", bytearray(raw))], "mailbox string, content binary")
    assert mail.messages(rows, datetime(2023, 1, 1, tzinfo=timezone.utc)).first()["processed_text"] == "S\n\nbody"
    assert mail.messages(rows, datetime(2024, 2, 1, tzinfo=timezone.utc)).count() == 0


def test_news_windows():
    now = datetime(2024, 1, 3, 12, tzinfo=timezone.utc)
    assert [str(a) for a, _ in media.day_windows(media.NewsConfig("q", lookup_period="2d"), now)] == ["2024-01-03", "2024-01-02", "2024-01-01"]
    assert media.news_requests(media.NewsConfig("q", after_date="2024-01-03"), now)[0]["query"] == "q+after:2024-01-03+before:2024-01-04"
    with pytest.raises(ValueError):
        media.NewsConfig("q", lookup_period="1d", after_date="2024-01-01")
    with pytest.raises(ValueError):
        media.NewsConfig("q", before_date="2024-01-01")


def test_video_comments():
    one = lambda i: {"commentRenderer": {"commentId": i, "publishedTimeText": {"runs": [{"text": "2 days ago"}]}, "contentText": {"runs": [{"text": "hi"}, {"text": "!"}]}}}
    now = datetime(2024, 1, 3, tzinfo=timezone.utc)
    found = media.parse_comments({"x": [one("a"), {"y": one("a.b")}]}, now)
    assert [(c["id"], c["text"], c["ts"]) for c in found] == [("a", "hi!", datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())]
    assert media.embedded_json('<script>var data = {"a": [1]};</script>', "data") == {"a": [1]}


def test_web():
    assert web.links_of("<urlset xmlns='x'><url><loc> http://a </loc></url></urlset>") == ["http://a"]
    assert web.links_of("<feed><entry><link href='http://b'/></entry></feed>", feed=True) == ["http://b"]
    calls = []

    def flaky(request):
        calls.append(1)
        if len(calls) < 3:
            raise web.urllib.error.URLError("down")
        return b"ok"

    assert web.fetch("http://x", opener=flaky, backoff=0) == b"ok" and len(calls) == 3
    assert web.expand_urls(web.CrawlerConfig(["s"], is_sitemap=True), lambda u: "<u><loc>http://c</loc></u>") == ["http://c"]


@pytest.mark.parametrize(("positive", "negative", "label"), [(0.1, 9.0, "Strong Negative"), (0.9, 0.31, "Negative"), (0.8, 0.3, "Strong Positive"), (0.5, 0.1, "Positive"), (0.4, 0.3, "Neutral")])
def test_sentiment_labels(spark, positive, negative, label):
    assert convert.sentiment_label(positive, negative) == label
    assert spark.range(1).select(convert.sentiment_label_column(F.lit(positive), F.lit(negative))).first()[0] == label


def test_convertors(spark):
    row = analyze.dummy(payloads(spark, "some text here", source="Twitter"), "d").first().asDict()
    assert convert.overlay({"source_name": "x", "k": 1})(row)["source_name"] == "Twitter"
    assert convert.issue(summary_max_length=11)(row)["summary"] == "some [...]"
    assert "{quote}some text here{quote}" in convert.issue()(row)["description"]
    made = convert.ticket(labels_count=1)(row)
    assert made["tags"] == ["d"] and made["ticket"] == {"comment": {}}
    assert convert.message("{{ payload.processed_text }}|{{ payload['meta']['n'] }}")(row) == {"text": "some text here|0"}
    assert '"dummy_data": "d"' in convert.message()(row)["text"]
    assert convert.mapped({"meta": "m"}, {"m": lambda v: "c"}, convert.overlay())(row)["m"] == "c"


def test_enquiry(spark):
    meta = F.struct(F.lit(7).alias("id"), F.struct(F.lit("bob").alias("username")).alias("author_info"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    rows = payload(spark.range(1), F.lit("bad\nday"), F.lit("1"), meta=meta, source_name="Twitter")
    rows = with_segment(rows, "classifier_data", F.create_map(F.lit("negative"), F.lit(0.9), F.lit("food"), F.lit(0.5)))
    made = lambda df, **kw: convert.ready(convert.enquiries(df, partner_id="p", source_information="s", **kw).first().asDict())
    lines = made(rows, use_enquiry_api=True, base={"k": 1})
    assert lines["k"] == 1 and lines["enquiryMessage"].split("\n") == ["Source: s", "FeedbackBy: https://twitter.com/bob", "Sentiment: Negative", "TweetUrl: https://twitter.com/bob/status/7", "FormattedText: bad day", "PredictedCategories: food", "ReportedAt: 2024-01-01 05:30:00"]
    detail = json.loads(made(rows)["messageDetail"])
    assert detail["partnerId"] == "p" and detail["sentiment"] == "Negative" and detail["userProfile"] == "https://twitter.com/bob"
    other = made(rows.withColumn("source_name", F.lit("x")), base={"k": 1})
    assert other["source_name"] == "x" and other["k"] == 1 and other["processed_text"] == "bad\nday"
    bare = made(payload(spark.range(1), F.lit(None).cast("string"), F.lit("1"), source_name="Twitter"), use_enquiry_api=True)["enquiryMessage"]
    assert "ReportedAt" not in bare and "Sentiment: Neutral" in bare


def test_default_transport_sends_lines_and_methods(monkeypatch):
    """Bulk bodies go out as they are, and an index is made by PUT; through an opener instead of a network."""
    import urllib.request

    from prosegrid.sources import web

    sent = []

    class Answer:
        def read(self):
            return b"{}"

    monkeypatch.setattr(web.urllib.request, "urlopen", lambda request, timeout: sent.append(request) or Answer())
    deliver.SearchIndexSink("http://x").create_index(lambda name: False)
    deliver.post({"url": "http://x/_bulk", "ndjson": '{"create":{}}\n{"a":1}\n'})
    deliver.post({"url": "http://x", "json": {"a": "é"}, "headers": {"X": "y"}})
    assert [(r.get_method(), r.full_url) for r in sent] == [("PUT", "http://x/es_index"), ("POST", "http://x/_bulk"), ("POST", "http://x")]
    assert json.loads(sent[0].data) == deliver.STRING_KEYWORDS and sent[1].data == b'{"create":{}}\n{"a":1}\n'
    assert sent[1].get_header("Content-type") == "application/x-ndjson" and json.loads(sent[2].data) == {"a": "é"}
    assert isinstance(sent[0], urllib.request.Request)


def test_ticket_auth_precedence():
    assert deliver.ticket_auth(email="e", token="t", oauth_token="o") == {"Authorization": "Bearer o"}
    assert deliver.ticket_auth(email="e", token="t") == deliver.basic_auth("e/token", "t")
    with pytest.raises(ValueError):
        deliver.ticket_auth(email="e", password="p", token="t")


def test_sinks_send_from_executors(spark, tmp_path):
    out = str(tmp_path)

    def keep(request):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            json.dump(request, f)

    deliver.http_sink("http://x", base_payload={"k": 1}, payload_mapping={"processed_text": "text"}, transport=keep).send(payloads(spark, "a", "b"))
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(s["json"]["text"] for s in sent) == ["a", "b"] and all(s["json"]["k"] == 1 for s in sent)


def test_bulk_sink_batches(spark, tmp_path):
    out = str(tmp_path)

    def keep(request):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write(request["ndjson"])

    deliver.SearchIndexSink("http://x", batch=2, transport=keep).send(payloads(spark, "a", "b", "c").coalesce(1))
    assert sorted(len(p.read_text().splitlines()) for p in tmp_path.iterdir()) == [2, 4]


def test_workflow_store(spark, tmp_path):
    store = WorkflowStore(spark, f"file://{tmp_path}/flows")
    flow = Workflow({"a": 1})
    assert Workflow().id != Workflow().id and store.get("none") is None and store.get_all() == []
    store.add_workflow(flow)
    assert store.get(flow.id).config == {"a": 1} and store.get_source_state(flow.id) is None
    store.update_state(flow.id, "source", {"k": {"since_id": "1"}})
    store.update_state(flow.id, "sink", {"s": 1})
    assert store.get_source_state(flow.id) == {"k": {"since_id": "1"}} and store.get_sink_state(flow.id) == {"s": 1}
    with pytest.raises(KeyError):
        store.update_state("none", "source", {})
    late = {**store._row(flow.id), "version": store._row(flow.id)["version"]}
    with pytest.raises(Conflict):
        store._write(late)  # a writer that started from the version before
    store.delete_workflow(flow.id)
    assert store.get(flow.id) is None


def test_pipeline_commits_after_the_sink(spark, tmp_path):
    store = WorkflowStore(spark, f"file://{tmp_path}/flows")
    flow = Workflow()
    store.add_workflow(flow)
    records = spark.createDataFrame([("k", "1", datetime(2024, 1, 1, 1), "a"), ("k", "2", datetime(2024, 1, 1, 2), "b")], "key string, id string, ts timestamp, text string")
    fresh = lambda cursors: cursor.newer(records, cursors, datetime(2023, 1, 1, tzinfo=timezone.utc))
    sent = []

    class Keep:
        def send(self, rows):
            sent.append(rows.count())

    class Broken:
        def send(self, rows):
            raise OSError

    source = lambda cursors: payload(fresh(cursors), F.col("text"), F.col("id"), meta=F.struct("key", "ts"))
    read = lambda rows: rows.select("meta.key", F.col("payload_id").alias("id"), "meta.ts")
    with pytest.raises(OSError):
        Pipeline(source, [], Broken()).run(flow, store, progress=read)
    assert store.get_source_state(flow.id) is None
    for _ in range(2):
        assert Pipeline(source, [lambda df: analyze.dummy(df, "x")], Keep()).run(flow, store, progress=read)
    assert sent == [2, 0]

    late = spark.createDataFrame([("k", "3", datetime(2024, 1, 1, 2, 0, 0, 500), "c")], "key string, id string, ts timestamp, text string")
    now = [records.unionByName(late)]

    class Arrives(Keep):
        def send(self, rows):
            super().send(rows)
            now[0] = now[0].unionByName(spark.createDataFrame([("k", "4", datetime(2024, 1, 1, 3), "d")], late.schema))  # arrives while it sends

        def state(self):
            return {"sent": len(sent)}

    growing = lambda cursors: payload(cursor.newer(now[0], cursors, datetime(2023, 1, 1, tzinfo=timezone.utc)), F.col("text"), F.col("id"), meta=F.struct("key", "ts"))
    for _ in range(2):
        assert Pipeline(growing, [], Arrives()).run(flow, store, progress=read)
    assert sent == [2, 0, 1, 1]  # half a second counts, and what arrived while sending comes next
    assert store.get_sink_state(flow.id) == {"0": {"sent": 4}}
    assert not Pipeline(source, []).run()


def test_configuration():
    made = configuration.Configuration("analyzer:\n  _target_: ClassifierConfig\n  labels: [a]\nsteps:\n  - _target_: SplitterConfig\n    max_split_length: 7\n")
    assert made.initialize("analyzer").labels == ["a"]
    assert made.initialize("steps")[0].max_split_length == 7
    assert made.initialize("nothing") is None
    with pytest.raises(ValueError):
        configuration.build({"_target_": "os.system"})
