import struct
from collections import Counter, defaultdict
from zlib import crc32

import xxhash

from prosegrid.llm import sharding
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.collect()]


def check(found, given, shards):
    assert len(found) == len(given)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == crc32(data)
        assert 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = defaultdict(set)
    for r in found:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(v) == 1 for v in by_key.values())


def test_odd_rows(odd):
    found = rows(sharding.shard_documents(odd, 4, bucket_bytes=1 << 16))
    check(found, odd.collect(), 4)
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((r["doc_id"], r["text"]) for r in odd.collect())


def test_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


def test_clashing_columns(odd):
    clash = odd.withColumns({"Shard": F.lit("x"), "slot": F.lit("y"), "text_CRC32": F.lit(1), "other": F.lit(5)})
    found = sharding.shard_documents(clash, 3)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "other", *sharding.ADDED}
    check(rows(found), odd.collect(), 3)


def test_even_and_repeatable(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("text"))
    first = sharding.shard_documents(docs, 16, bucket_bytes=1 << 12).select("doc_id", "shard", "slot", "grown_shard")
    again = sharding.shard_documents(docs.repartition(7), 16, bucket_bytes=1 << 12).select("doc_id", "shard", "slot", "grown_shard")
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, again.collect()))
    sizes = Counter(r["shard"] for r in first.collect())
    assert len(sizes) == 16 and max(sizes.values()) < 1.2 * min(sizes.values())
    moved = [r for r in first.collect() if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 0.7 < len(moved) * 17 / 20_000 < 1.3
    # The order inside a shard is a shuffle, not the order of the ids.
    one = [r["doc_id"] for r in sorted(first.where("shard = 3").collect(), key=lambda r: r["slot"])]
    up = sum(a < b for a, b in zip(one, one[1:]))
    assert 0.4 < up / len(one) < 0.6


def test_main_path_is_native(odd):
    plan = sharding.shard_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shard_documents(odd, 4), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == odd.count()


def brute_shard(key, shards, seed):
    """The law, with the hashes taken from the xxhash library."""
    found = 0
    for k in range(1, shards):
        h = 42
        for data in (struct.pack("<q", key), struct.pack("<i", k), struct.pack("<i", seed)):
            h = xxhash.xxh64_intdigest(data, h)
        if (h - (1 << 64) if h >> 63 else h) % (k + 1) == 0:
            found = k
    return found


def test_query_equals_brute_force(spark):
    from prosegrid.llm import queries

    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = queries.op1_sharding(spark, data).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(docs.keys())
    for r in found:
        own = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(own) + 1, crc32(own), "key")
        assert r["shard"] == brute_shard(r["doc_id"], 16, 20240229) and r["grown_shard"] == brute_shard(r["doc_id"], 17, 20240229)
    for shard in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))


def test_equal_rows_spread_over_buckets(spark):
    """Rows that are equal in everything: no bucket holds more than its bytes, by and large."""
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 199).alias("text")).repartition(4)
    found = sharding.shard_documents(rows, 4, bucket_bytes=16_000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert found.count() == 3000 and max(sizes) * 200 < 3 * 16_000
    assert sorted(r["slot"] for r in found.collect()) == list(range(3000))


def test_several_buckets_a_task(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASKS", 3)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("text of some length").alias("text"))
    found = sharding.shard_documents(rows, 8, bucket_bytes=500).collect()
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
