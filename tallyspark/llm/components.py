"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hot import lookup
from tallyspark.session import drop_scratch, store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (columns a, b); a component is named by its smallest node.

    Each round takes the smallest label among a node's neighbours and then its
    label's label, so long chains halve.  Labels are stored after each round;
    minima are partial before the shuffle, and a hub or a label that holds a
    large part of all links or nodes is looked up where its rows are, so no
    task gathers it.  Null ends are ignored; no links give an empty table.
    """
    spark = links.sparkSession
    both = links.filter("a IS NOT NULL AND b IS NOT NULL").select(
        F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct()
    edges, edge_path = store(both, "edges")
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l"), F.count(F.lit(1)).alias("count"))
    start, start_path = store(least, "labels")
    degrees = start.select(F.col("u").alias("v"), "count")  # links stand in both directions
    nodes, n_links = start.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    labels, path = start.select("u", "l"), None
    while True:
        near = lookup(edges, labels.select(F.col("u").alias("v"), "l"), "v", degrees, n_links).groupBy("u").agg(
            F.min("l").alias("m"))
        step, step_path = store(labels.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l")), "labels")
        sizes = step.groupBy("l").agg(F.count(F.lit(1)).alias("count"))
        up = labels.select(F.col("u").alias("l"), F.col("l").alias("tl"))
        jumped = lookup(step, up, "l", sizes, nodes).select("u", "was", F.least("l", "tl").alias("l"))
        new, new_path = store(jumped, "labels")
        changed = new.filter("l <> was").limit(1).count()
        drop_scratch(spark, step_path)
        if path:
            drop_scratch(spark, path)
        labels, path = new.select("u", "l"), new_path
        if not changed:
            drop_scratch(spark, edge_path)
            drop_scratch(spark, start_path)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
