"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins over the edges; edges and labels
stay distributed and every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v.  Large: each vertex hangs its larger neighbours on the
    least vertex that it sees.  Small: its smaller neighbours and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = near.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of every vertex of `links` (u, v: long) but the least of each
    component; component is that least vertex.  Loops, nulls, repeated and
    reversed links are allowed."""
    state, before = None, None
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        fresh = common.stored(_star(_star(edges, True), False), tag)
        if state is not None:
            common.forget(state)
        state = fresh
        edges = state
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
