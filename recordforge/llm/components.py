"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordforge.sources.tables import discard, few_tasks, materialise

#: Rounds grow with the logarithm of the longest path; so many would be a fault of this code.
MOST_ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); the root is the smallest node.

    Each round hangs every node's larger neighbours on the smallest neighbour,
    then its smaller ones; the minimum is a partial aggregate. It ends when every
    node is tied to its root alone, which that aggregate tells too: no node has both a
    smaller neighbour and another one.

    Edges from a node to itself and repeated edges count for nothing, so a node
    with no other edge has no row; without edges the result is empty. Edges with
    a null end must not be given. The result is a table, which `discard` deletes.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), "edges")
    rows = now.count()  # no round adds to them
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = few_tasks(both.groupBy("u").agg(F.min("v").alias("_least"), F.max("v").alias("_most")), 2 * rows)
        # Written, so that both sides of the join are plain exchanges, which Spark splits where a node is a hub.
        least = materialise(ends.select(F.col("u").alias("node"), F.least("_least", "u").alias("root"), ((F.col("_least") < F.col("u")) & (F.col("_most") > F.col("_least"))).alias("loose")), "roots")
        if least.filter("loose").isEmpty():
            discard(now)
            roots = least.select("node", "root")
            roots._scratch = least._scratch
            return roots
        large = few_tasks(now.join(least.select(F.col("node").alias("v"), F.col("root").alias("m")), "v").select("u", F.col("m").alias("v")).distinct(), rows)
        small_least = few_tasks(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialise(few_tasks(small, rows), "edges")
        discard(now)
        discard(least)
        now = after
    raise RuntimeError("components did not settle")
