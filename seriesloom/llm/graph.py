"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a long, b long); component: the smallest node that it reaches.

    In each round every node joins the neighbour (or itself) that a hash of node and round puts first, and
    the nodes that were joined become one; a second hop shortens chains.  The hash makes the
    expected number of rounds logarithmic whatever the shape.  A hub's neighbours are folded by
    a combinable minimum.  Loops and repeated edges are harmless; edges with a null end are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    names = store(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("name")), "graph-names")
    live = store(edges.where("a <> b").distinct(), "graph-live")
    turn = 0
    while not live.isEmpty():
        turn += 1
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("to"))
        ends = live.union(live.select("b", "a"))
        chosen = ends.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["to"].alias("to"))
        chosen = chosen.select(F.col("a").alias("of"), "to")
        hop = chosen.alias("x").join(chosen.alias("y"), F.col("x.to") == F.col("y.of")).select(F.col("x.of").alias("of"), F.col("y.to").alias("to"))
        hop = store(hop, "graph-moves")
        names = store(names.join(hop, names.name == hop.of, "left").select("node", F.coalesce("to", "name").alias("name")), "graph-names")
        one = live.join(hop.toDF("a", "a_to"), "a").join(hop.toDF("b", "b_to"), "b")
        live = store(one.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct(), "graph-live")
    smallest = store(names.groupBy("name").agg(F.min("node").alias("component")), "graph-smallest")
    return store(names.join(smallest, "name").select("node", "component"), "graph-components")
