"""Connected components by alternating large-star and small-star steps.

A large-star step links every node's larger neighbours to its smallest one (or
itself); a small-star step links its smaller neighbours and itself to the
smallest.  Both keep the components; alternated until only stars remain, they
leave every node linked to the smallest node of its component alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hot import lookup
from tallyspark.session import drop_scratch, store


def _least_neighbours(spark, edges: DataFrame):
    """(u, m, count): each node's smallest neighbour (stored), and the number of edges."""
    least, path = store(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("count")), "least")
    total = least.agg(F.sum("count")).first()[0] or 0
    return least, path, total


def _large_star(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    both, both_path = store(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least, path, total = _least_neighbours(spark, both)
    smallest = least.select("u", F.least("u", "m").alias("m"))
    out = lookup(both, smallest, "u", least, total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    done, done_path = store(out.filter("u <> v").distinct(), "stars")
    drop_scratch(spark, both_path)
    drop_scratch(spark, path)
    return done, done_path


def _small_star(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    down, down_path = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "down")
    least, path, total = _least_neighbours(spark, down)
    moved = lookup(down, least.select("u", "m"), "u", least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    done, done_path = store(out, "stars")
    drop_scratch(spark, down_path)
    drop_scratch(spark, path)
    return done, done_path


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to a smaller one, no node has two of them, and none of the smaller nodes has one."""
    one = F.lit(1)
    ends = edges.select(F.col("u").alias("node"), one.alias("out"), (F.col("u") < F.col("v")).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(False).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(one).alias("all"), F.max("up").alias("up"))
    return nodes.filter("up OR out > 1 OR (out = 1 AND all > 1)").isEmpty()


def star_components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of all nodes of ``links`` (columns a, b), a component named by its smallest node; and its path.

    Null ends and links of a node to itself are ignored; repeated links count
    once; no links give an empty table.
    """
    spark = links.sparkSession
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges, path = store(edges.distinct(), "stars")
    while not _are_stars(edges):
        for step in (_large_star, _small_star):
            new, new_path = step(edges)
            drop_scratch(spark, path)
            edges, path = new, new_path
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    named, named_path = store(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots),
                              "components")
    drop_scratch(spark, path)
    return named, named_path
