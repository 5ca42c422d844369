"""Connected components of an edge list, by rounds of hooking, pointer jumping and contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): each node of an edge and the smallest node that it reaches.

    In each round every node hooks onto its smallest neighbour (a minimum, combined before the shuffle), trees are
    shortened by two pointer jumps, and edges are contracted to roots. Edges shrink geometrically; all state is in
    the shared folder. Loops and repeated edges do no harm; no edges give no rows."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    found = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent")), "parents")
        near = p
        for _ in range(2):
            up = near.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            near = near.join(up, "parent").select("node", F.col("above").alias("parent"))
        q = written(near, "parents")
        discard(p)
        # labels become exact minima: hooks only ever go to smaller nodes, so a root is the least of its tree
        if found is None:
            done = q.select("node", F.col("parent").alias("root"))
        else:
            done = found.join(q.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        found = written(done, "roots")
        ends = lambda c: q.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))
        e = written(e.join(ends("u"), "u").join(ends("v"), "v").select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).where("u <> v").distinct(), "edges")
    if found is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
