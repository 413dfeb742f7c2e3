"""Scratch tables live as long as the scope they are stored in."""

from prosegrid import scratch


def test_scopes(spark):
    with scratch.scope(spark):
        with scratch.scope(spark):
            inner = scratch.stored(spark.range(5), "inner")
            kept = scratch.stored(spark.range(6), "kept", keep=True)
            paths = inner.inputFiles()[0], kept.inputFiles()[0]
            assert inner.count() == 5 and all(scratch_exists(spark, p) for p in paths)
        assert kept.count() == 6 and [scratch_exists(spark, p) for p in paths] == [False, True]
    assert not scratch_exists(spark, paths[1])
    free = scratch.stored(spark.range(7), "free")
    assert free.count() == 7 and scratch_exists(spark, free.inputFiles()[0])


def scratch_exists(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
