import hashlib
import random
import re
from collections import Counter

import pytest

from prosegrid.llm import urlfilter, warc
from pyspark.sql import functions as F

ALLOW, BLOCK = [("org", "/"), ("com", "/fr/")], [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/"), ("", "/x")]


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for rules, v in ((ALLOW, "allow"), (BLOCK, "block")) for h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def urls():
    rng = random.Random(6)
    hosts = ["example.org", "a.example.org", "example.com", "notexample.org", "org", "com", "EXAMPLE.Com", "x.net", "", "a..org", "user@example.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/en/2", "/fr/a", "/de/b#c", "/DE/", "?q=/es/", "#/es/"]
    out = [f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)]
    return out + [None, "", "no scheme", "example.org/es/", "://", "http://", "http://a://b/c"]


def test_rules_equal_brute_force(spark):
    own = urls()
    df = spark.createDataFrame(list(enumerate(own)), "page_id long, url string").repartition(4)
    found = urlfilter.filter_urls(df.withColumn("Verdict", F.lit(1)), ALLOW, BLOCK)
    assert found.columns == ["page_id", "url", *urlfilter.ADDED]
    for r in found.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(r["url"]), r["url"]
    assert found.count() == len(own)
    assert urlfilter.filter_urls(df.limit(0), ALLOW, BLOCK).count() == 0


def test_cascade_is_exact(spark):
    listed = {f"key{n}" for n in range(0, 3000, 3)}
    universe = {f"key{n}" for n in range(3000)} - {"key0"}
    frame = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    cascade = urlfilter.build_cascade(frame(listed), frame(universe))
    assert len(cascade.levels) >= 2
    assert all((k in cascade) == (k in listed) for k in universe | listed)
    assert "x" not in urlfilter.build_cascade(frame(set()), frame(universe))


def test_any_number_of_keys_is_exact(spark):
    """A bound of a few bytes gives many shards, and the same rows."""
    df = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string").repartition(2)
    whole, cut = (sorted(map(str, urlfilter.filter_urls(df, ALLOW, BLOCK, filter_bytes=b).collect())) for b in (1 << 20, 4))
    assert whole == cut


def test_shards_are_the_same_in_both_languages(spark):
    keys = [f"é{n}.org/" for n in range(200)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    assert all({r["key"] for r in urlfilter.in_shard(frame, k, 3).collect()} == {x for x in keys if urlfilter.shard_of(x, 3) == k} for k in range(3))


def test_arc_versions():
    records = [("http://a/", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>\n\n1 0 x</p>"), ("http://b/", "0.0.0.0", "20200102", "text/plain", b"")]
    for version in (1, 2):
        own = list(warc.read_arc(warc.write_arc(records, version, "n.arc", "20200101000000")))
        assert [r.block for r in own[1:]] == [r[4] for r in records]
        assert {r.version for r in own} == {version} and own[0].fields["URL"] == "filedesc://n.arc"
        assert len(own[1].fields) == (5 if version == 1 else 10)
        head, block = next(h for h in warc.read_warc(warc.convert(own[1])))
        assert head["WARC-Type"] == "response" and head["WARC-Date"] == "2020-01-02T03:04:05Z" and block == records[0][4]
        assert head["WARC-Payload-Digest"] == warc.digest(b"<p>\n\n1 0 x</p>")
        head, block = next(h for h in warc.read_warc(warc.convert(own[2])))
        assert head["WARC-Type"] == "resource" and head["WARC-Date"] == "2020-01-02T00:00:00Z"


def test_damaged_archives_are_errors():
    good = warc.write_arc([("http://a/", "0.0.0.0", "20200101000000", "text/html", b"abc")], 1, "n", "20200101000000")
    with pytest.raises(ValueError):
        list(warc.read_arc(good[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_arc(good.replace(b"http://a/ 0.0.0.0", b"http://a/")))
    with pytest.raises(ValueError):
        list(warc.read_warc(b"junk\r\n"))


def pages():
    big, other = "é" * 600, "y" * 1000
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (5, "http://a b/5", big), (3, None, "small"), (4, "http://a/4", "small"), (6, "http://a/6", None), (7, "", ""),
        (8, "http://a/8", other), (8, "http://a/8", other), (None, "http://a/n", other), (9, "http://a/9", "x" * 999), (10, "http://a/10", "x" * 999), (11, "http://a\n/", "WARC/1.1\r\n\r\n" * 200),
    ]


def test_archives_read_back(spark):
    own = pages()
    found = warc.archived(spark.createDataFrame(own, "page_id long, url string, html string").repartition(3).withColumn("payload", F.lit(1)))
    top = {}
    for key, _, html in own:
        if key is not None and len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, key), key)
    want = Counter()
    for key, _, html in own:
        data = (html or "").encode()
        origin = top.get(html)
        other = origin is not None and origin != key
        want[(key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", origin if other else None, None if other else data)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found.collect()) == want


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
