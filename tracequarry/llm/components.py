"""Connected components of an edge table by repeated contraction; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """A written table of node, label (the same for all nodes of a component) for every node of edges (a, b).

    Each round maps a node to the least of itself and its neighbours and keeps the edges between different images. Node names should be
    hashes, so that chains shrink by a constant factor a round on average.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while e.limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        maps.append(written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels"))
        a, b = (maps[-1].select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
        moved = e.join(a, "a").join(b, "b").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        after = written(moved.where("a <> b").distinct(), "edges")
        discard(e)
        e = after
    labels = maps[0] if maps else e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for step in maps[1:]:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    out = written(labels, "components")
    discard(e, *maps)
    return out
