"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.skew import salted_join
from locusframe.session import Rounds, cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the component is its smallest node.

    Every round takes the smallest label among a node and its neighbours and then
    jumps to the label's own label, so that long paths close in few rounds.  The
    minimum over neighbours is combined before the shuffle and the look-up of a
    neighbour's label is salted by degree: a node with a third of all edges is never
    gathered.  Null ends and edges from a node to itself add no link (a node with only
    such an edge is a component of its own); repeated edges change nothing.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("x")).select("x.u", "x.v")
    both = cut(both.filter("u is not null and v is not null").distinct(), "links")
    rounds = Rounds(edges.sparkSession, "labels")
    labels = rounds.put(both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), "degree"))
    while True:
        near = salted_join(both.select(F.col("v").alias("node"), F.col("u").alias("to")), labels, "node", "degree")
        near = near.groupBy(F.col("to").alias("node")).agg(F.min("label").alias("near"))
        nxt = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("jump"), "degree", F.col("label").alias("was"))
        nxt = cut(nxt, "near")
        # how many nodes share a label is what a hot label needs salts for
        sizes = nxt.groupBy("jump").agg(F.count(F.lit(1)).alias("n"))
        own = cut(sizes.join(nxt.select(F.col("node").alias("jump"), F.col("jump").alias("label")), "jump"), "own")
        after = salted_join(nxt, own, "jump", "n", spread=["node"])
        labels = rounds.put(after.select("node", F.least("label", "jump").alias("label"), "degree", "was"))
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("was")
