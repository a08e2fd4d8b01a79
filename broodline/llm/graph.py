"""Connected components of an edge table, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodline.sources.scratch import scratch_path


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with what is known of their node ``a``.

    The hash in the key gives both sides an exchange of their own behind the
    aggregation, and only such joins are split where a node has very many edges.
    """
    one, other = (df.withColumn("__hash", F.xxhash64("a")) for df in (edges, nodes))
    return one.join(other.hint("merge"), ["a", "__hash"]).drop("__hash")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its least node.

    Alternates the large-star and small-star steps until nothing changes. A step
    is an aggregation with map-side combining and an equi-join that adaptive
    execution splits where a node has very many edges. Loops (a = b) are
    ignored, directions and repeated edges do not matter; no edges give no rows.
    """
    now = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = settled(now.distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = met(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, down)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))
        )
        now = settled(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        heads.distinct()
    )
