"""SQL functions, polled streams, transports and incremental streams."""

import json
from datetime import datetime, timezone

from prosegrid.functions import sql
from prosegrid.sources import mail, media, polling, reviews, social
from prosegrid.streaming import incremental
from pyspark.sql import functions as F


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT visible_text('<p>a</p>') AS a, porter_stem('running') AS b, url_id('test') AS c, decode_unicode(array('é', NULL)) AS d, shorten(NULL) AS e").first()
    assert tuple(row) == ("a", "run", "ba6bd213", ["e", None], None)
    rows = spark.sql("SELECT c.phrase, c.chunk_id, c.total_chunks FROM (SELECT 'aa bb cc' AS t) d, LATERAL text_chunks(d.t, 5, 0) c ORDER BY 2").collect()
    assert [tuple(r) for r in rows] == [("aa bb", 0, 2), ("cc", 1, 2)]


def test_polled_stream_loses_nothing(spark, tmp_path):
    """More new records than a page or maxCount holds: the stream reads them all."""

    def service(request, token):
        upto = int(token) if token else 100
        return [{"id": n, "ts": 1000 + n, "text": "t"} for n in range(upto, max(0, upto - 7), -1)], str(upto - 7) if upto > 7 else None

    spark.dataSource.register(polling.data_source({"hundred": service}))
    options = {"requests": '[{"key": "a"}, {"key": "b"}]', "transport": "hundred", "maxCount": "30"}
    run = spark.readStream.format("polled").options(**options).load().writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination(60)
    run.stop()
    found = spark.read.parquet(f"file://{tmp_path}/out").groupBy("key").agg({"id": "count"}).collect()
    assert sorted(tuple(r) for r in found) == [("a", 100), ("b", 100)]


def test_polled_stream_reads_once(spark, tmp_path):
    def service(request, token):
        return [{"id": n, "ts": n, "text": str(n)} for n in (30, 20, 10)], None

    spark.dataSource.register(polling.data_source({"three": service}))
    options = {"requests": json.dumps([{"key": "a", "since": 10}, {"key": "b"}]), "transport": "three"}
    assert sorted(r["id"] for r in spark.read.format("polled").options(**options).load().collect()) == ["10", "20", "20", "30", "30"]
    for _ in range(2):
        query = (
            spark.readStream.format("polled").options(**options).load().writeStream.format("parquet")
            .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
        )
        query.processAllAvailable() if _ == 0 else query.awaitTermination(3)
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_incremental_stream_takes_new_files_once(spark, tmp_path):
    source, counted = f"{tmp_path}/in", []
    frame = lambda n: spark.createDataFrame([(n, "x")], "id long, text string")
    for n in range(3):
        frame(n).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, text string").parquet(source)
        incremental.run_available(stream, f"{tmp_path}/check", lambda rows: counted.extend(r["id"] for r in rows.collect()), steps=[lambda d: d.where("id >= 0")]).awaitTermination()
    assert counted == [0, 1, 2]


def test_search_requests():
    config = social.SearchConfig(query="q", lookup_period="1h", fields={"tweet.fields": ["id", "text"]})
    request = social.search_request(config)
    assert request["tweet.fields"] == "id,text" and "start_time" in request and "since_id" not in request
    assert "start_time" not in social.search_request(social.SearchConfig(query="q", lookup_period="1h", since_id=5))
    sent = {}

    def post(url, headers, data):
        sent.update(headers)
        return b'{"access_token": "t"}'

    assert social.bearer_token("k", "s", "http://x", post) == "t" and sent["Authorization"] == "Basic azpz"


class Mailbox:
    def select(self, name, readonly):
        return "OK", [b"2"]

    def fetch(self, number, what):
        return "OK", [(b"1", f"Subject: S{number}\r\nDate: Mon, 0{number} Jan 2024 10:00:00 +0000\r\nMessage-ID: <{number}>\r\n\r\nbody".encode())]

    def logout(self):
        pass


def test_mailbox_pages():
    read = mail.mailbox_transport(lambda request: Mailbox(), page=1)
    records, token = read({"key": "INBOX"}, None)
    assert [r["id"] for r in records] == ["<2>"] and token == "1"
    assert [r["id"] for r in polling.pages(read, {"key": "INBOX"}, 0, None)] == ["<2>", "<1>"]


def test_comment_pages():
    page = '<script>var ytInitialData = {"itemSectionRenderer": {"continuationEndpoint": {"t": 1}}};</script>'
    one = lambda i: {"commentRenderer": {"commentId": i, "publishedTimeText": {"runs": [{"text": "1 hour ago"}]}, "contentText": {"runs": [{"text": i}]}}}
    answers = {1: {"items": [one("a"), one("a.b")], "continuationEndpoint": {"t": 2}}, 2: {"items": [one("c")]}}
    clock = lambda: datetime(2024, 1, 1, tzinfo=timezone.utc)
    read = media.comment_transport(lambda url: page, lambda token: answers[token["t"]], clock=clock)
    assert [r["id"] for r in polling.pages(read, {"url": "u"}, 0, None)] == ["a", "c"]
    assert list(polling.pages(media.comment_transport(lambda url: "none", None), {"url": "u"}, 0, None)) == []


def test_windows(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 55), "a", 2.0), (datetime(2024, 1, 1, 1, 0), "b", 4.0)], "ts timestamp, event_type string, value double")
    assert [tuple(r)[2:] for r in incremental.windowed_counts(rows).orderBy(F.col("window_start")).collect()] == [(2, 3.0), (1, 4.0)]


def test_tolerant_transport():
    def broken(request, token):
        raise RuntimeError("down")

    assert list(polling.pages(polling.tolerant(broken), {"key": "x"}, 0, None)) == []


def test_place_requests():
    config = reviews.PlaceReviewsConfig(["a cafe"], since_timestamp=5)
    assert config.request()["cutoff"] == 5 and config.request(9)["cutoff"] == 9 and "start" not in config.request()
