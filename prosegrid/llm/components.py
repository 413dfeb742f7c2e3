"""Connected components of a graph given as an edge table, by repeated contraction.

Every round each vertex chooses the least vertex of its closed neighbourhood, the graph is
contracted along these choices, and edges that have become loops or repeats go. Even rounds
order vertices by their ids, which takes stars in one round; odd rounds order them by a hash of
the round, which shrinks any graph (long paths too) by a constant factor in expectation. Only
minima are aggregated and only joins on single keys are used, so a vertex with very many
neighbours is never gathered anywhere: partial aggregation or skew-join splitting takes it.
Each round is written to the shared folder; the driver sees only edge counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each vertex of ``edges`` (a long, b long); root is the same for all of a component.

    Loops, repeats and nulls are allowed; vertices without an edge to another vertex have no row.
    """
    spark = edges.sparkSession
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.lit(0)) if len(rounds) % 2 == 0 else (lambda c, n=len(rounds): F.xxhash64(c, F.lit(n)))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("v"))).alias("m"))
        chosen = stored(least.select("node", F.least("m", F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("v")))["v"].alias("root")), "chosen")
        rounds.append(chosen)
        left, right = chosen.toDF("a", "ra"), chosen.toDF("b", "rb")
        links = stored(
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds.pop()
    while rounds:
        later = out.toDF("root", "last")
        out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
