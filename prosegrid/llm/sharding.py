"""Sharding: a two-pass external shuffle made of DataFrame operations only.

Pass one gives every record a shard and a seeded hash, from which its memory-sized bucket follows,
and writes the records, so that all that comes later reads the same rows. Pass two deals the
buckets out, shuffles each with Spark's own ``shuffle`` (a Fisher-Yates shuffle of an array, seeded)
and numbers the rows without gaps; ``write_shards`` writes them.

A bucket that has over twice its bytes (many rows with one key, or equal in everything) is cut into
parts by the numbers of its rows, which go to different tasks. A task takes one bucket, of very many
buckets (over ``TASKS``) several, one after the other. The number of rows before a bucket travels to
its task as a row of its own. The order is the same however the input is dealt out, but for rows of cut buckets.

Law: ``key``. The shard depends on the key and the number of shards alone: row ``r`` lies in
the largest ``k < n`` for which ``xxhash64(key, k, seed) mod (k + 1) = 0``. A shard ``n``
that is added takes one row in ``n + 1`` and no row moves between older shards.

Defined cases: an empty table gives no rows; a null key is a key like any other (all such rows
share a shard, but spread over its buckets); equal rows are kept, each with a
slot of its own; a very long text is a record like any other; a null text has size 1 and the CRC of nothing is null -> 0; columns of the
input that are named like an output column are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.base import stored, without

BUCKET_BYTES = 8 << 20
TASKS = 100_000
BROADCAST_BUCKETS = 200_000  # rows of two numbers
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key among ``shards`` (the law ``key`` above)."""
    steps = [F.when(F.pmod(F.xxhash64(key, F.lit(k), F.lit(seed)), F.lit(k + 1)) == 0, k).otherwise(0) for k in range(1, shards)]
    return F.greatest(F.lit(0), F.lit(0), *steps).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text", seed: int = 20240229, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Rows of a shard follow each other by slot in a random order that the seed fixes. Buckets hold
    about ``bucket_bytes`` of text, so that memory does not depend on the size of the table.
    """
    docs = without(docs, ADDED)
    names = docs.columns
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    placed = stored(
        docs.select(
            *[F.col(f"`{c}`") for c in names],
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("__size"),
            crc.alias("__crc"), shard_of(F.col(key), shards, seed).alias("__shard"),
            F.xxhash64(F.lit(seed + 1), F.col(key), crc).alias("__hash"), F.monotonically_increasing_id().alias("__row_number"),
        ),
        "scattered",
    )
    total = placed.agg(F.sum("__size").alias("n")).first()["n"] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    each = -(-shards * per_shard // TASKS)  # buckets of a task
    tasks = -(-shards * per_shard // each)
    placed = placed.withColumn("__bucket", F.col("__shard") * F.lit(per_shard) + F.pmod("__hash", F.lit(per_shard)))
    bytes_of = placed.groupBy("__bucket").agg(F.sum("__size").alias("n")).where(F.col("n") > 2 * bucket_bytes)
    large = stored(bytes_of.select("__bucket", F.ceil(F.col("n") / bucket_bytes).cast("long").alias("__parts")), "large")
    if n_large := large.count():
        placed = placed.join(F.broadcast(large) if n_large <= BROADCAST_BUCKETS else large, "__bucket", "left")
    else:
        placed = placed.withColumn("__parts", F.lit(None).cast("long"))
    placed = placed.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__row_number"), F.col("__parts")), F.lit(0)))
    upto = Window.partitionBy("__shard").orderBy("__bucket", "__part")
    before = (
        placed.groupBy("__shard", "__bucket", "__part").agg(F.count(F.lit(1)).alias("__n"))
        .select("__bucket", "__part", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"))
    )
    own = [*names, "__size", "__crc", "__shard"]
    mixed = (
        placed.select("__bucket", "__part", "__hash", "__row_number", F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row")).unionByName(before, allowMissingColumns=True)
        .withColumn("__task", F.pmod(F.floor(F.col("__bucket") / each) + F.col("__part"), F.lit(tasks)).cast("int"))
        .repartitionById(tasks, F.col("__task"))
        .sortWithinPartitions("__bucket", "__part", "__hash", "__row_number")
        .groupBy("__task", "__bucket", "__part").agg(F.max("__before").alias("__before"), F.collect_list("__row").alias("__rows"))
        .select("__before", F.posexplode(F.shuffle("__rows", F.lit(seed))).alias("__at", "__row"))
    )
    return mixed.select(
        *[F.col(f"__row.`{c}`") for c in names],
        F.col("__row.__size").alias("size"),
        F.col("__row.__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__row.__shard").alias("shard"),
        (F.col("__before") + F.col("__at")).cast("long").alias("slot"),
        shard_of(F.col(f"__row.`{key}`"), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard; files of a shard follow each other by slot."""
    sharded.write.partitionBy("shard").parquet(path)
