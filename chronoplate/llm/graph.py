"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b); root is the smallest vertex of its component.

    In each round every vertex hooks to its smallest neighbour if that is smaller, hooks are followed twice, and edges are
    drawn anew between what remains; the smallest vertex of a component never hooks, so that it is what is left. Rounds are
    written to the shared folder. No edges give no rows. Self-loops and repeated edges do no harm."""
    edges = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    roots = written(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.col("v")), "roots")
    while not edges.isEmpty():
        near = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        hooks = first = written(near.select(F.col("a").alias("v"), F.least("a", "b").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("v").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("v", F.coalesce("top", "up").alias("up"))
        hooks = written(hooks, "followed")
        a, b = hooks.select(F.col("v").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("v").alias("b"), F.col("up").alias("ub"))
        left = written(edges.join(a, "a").join(b, "b").filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
        # Each round's tables are written, so that plans don't grow with rounds.
        below = written(roots.join(hooks.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("up", "root").alias("root")), "roots")
        dropped(edges, first, hooks, roots)
        edges, roots = left, below
    dropped(edges)
    return roots
