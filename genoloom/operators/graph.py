"""Components of long edge tables by contraction: every round is a few joins, its state written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.runtime import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of (u, v) edges; edges of a node to itself count for nothing.

    A node points at its smallest neighbour or itself, the pointers are followed once, and the
    edges between roots are the edges of the next round.
    """
    open_ = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    done = None
    while not open_.isEmpty():
        ends = open_.unionByName(open_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")))
        step = materialize(first.join(first.toDF("up", "root"), "up").select("node", "root"))
        rest = open_.join(step.toDF("u", "a"), "u").join(step.toDF("v", "b"), "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        rest = materialize(rest)
        if done is not None:
            moved = materialize(done.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            release(done, step)
        else:
            moved = step
        release(open_, first)
        done, open_ = moved, rest
    release(open_)
    if done is None:
        kind = dict(edges.dtypes)["u"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return done
