"""Connected components of a graph given as edges, by alternating stars.

Each round hangs the larger neighbours of every node onto the smallest one
(large star), then the smaller ones (small star), until every edge points from
a node to the smallest node of its component. The number of rounds grows with
the logarithm of the graph's size. A node's smallest neighbour comes from an
aggregation with partial sums, so a node of very many edges is no bottleneck;
the join that follows is one that Spark can split. Every round ends in a table
in the shared folder; the table of the round before is emptied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Loops, repeated edges and edges with a null end are ignored; a node with
    no other edge does not appear. No edges give an empty result.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "cc")
    edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(path)
    edges = spark.read.parquet(path)
    before = _mark(edges)
    for _ in range(max_rounds if before[0] else 0):
        last, path = path, fresh_path(spark, "cc")
        _small_star(_large_star(edges)).write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        release(spark, last)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
