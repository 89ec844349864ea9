"""Connected components by repeated contraction, every round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (id, label): for every node that has an edge, the smallest node it reaches.

    A round points each node at its smallest neighbour or itself, follows these pointers to their roots by doubling,
    and replaces the edges by those between different roots. Nodes at least halve each round, a component's smallest
    node is always a root, and no more is left to do when no edge is. Edges and labels stay on the executors."""
    edges = written(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        ends = edges.select(F.col("u").alias("id"), F.col("v").alias("n")).union(edges.select(F.col("v").alias("id"), F.col("u").alias("n")))
        roots = _rooted(written(ends.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("label")), "roots"))
        if labels is None:
            new = roots
        else:
            far = roots.select(F.col("id").alias("label"), F.col("label").alias("far"))
            new = written(labels.join(far, "label", "left").select("id", F.coalesce("far", "label").alias("label")), "labels")
        ru, rv = roots.select(F.col("id").alias("u"), F.col("label").alias("ru")), roots.select(F.col("id").alias("v"), F.col("label").alias("rv"))
        rest = edges.join(ru, "u").join(rv, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        rest = written(rest, "edges")
        dropped(edges)
        for t in (labels, roots):
            if t is not None and t is not new:
                dropped(t)
        edges, labels = rest, new
        if not edges.limit(1).count():
            dropped(edges)
            return labels


def _rooted(pointers: DataFrame) -> DataFrame:
    """(id, label) with every label replaced by the root that it leads to."""
    while True:
        far = pointers.filter("id <> label").select(F.col("id").alias("label"), F.col("label").alias("far"))
        out = written(pointers.join(far, "label", "left").select("id", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")), "roots")
        dropped(pointers)
        pointers = out.select("id", "label")
        pointers._stored_at = out._stored_at
        if not out.filter("moved").limit(1).count():
            return pointers
