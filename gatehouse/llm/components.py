"""Connected components by contraction.

In each round every node takes the first of its neighbours and itself, in an order that is hashed anew per round; edges
then join what was taken, and the smaller graph is contracted again. The minimum of a node's neighbours is taken before
the shuffle, so a hub costs no task more than its distinct neighbours per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatehouse.llm.rows import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that an edge (a, b) to another node has; a component's nodes share one of them as label."""
    left, rounds = _distinct(edges), []
    while left.limit(1).count():
        number = F.lit(len(rounds))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda name: F.struct(F.xxhash64(name, number).alias("order"), F.col(name).alias("label"))
        step = stored(both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select(
            F.col("a").alias("node"), F.least("near", ranked("a"))["label"].alias("label")), "contraction")
        first = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        second = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        rounds.append(step)
        left = _distinct(left.join(first, "a").join(second, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    labels = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = stored(step.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "labels")
    return labels


def _distinct(edges: DataFrame) -> DataFrame:
    return stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
