"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node reachable from each node of ``links``.

    Every round gives each node its smallest neighbour as parent, follows
    parents to a root by doubling, and goes on with the links between roots
    only; paths shrink to half at least, so rounds grow with the logarithm of
    the longest path. Nodes without links don't occur. Null ends are ignored.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    ends = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not ends.isEmpty():
        both = ends.union(ends.select("b", "a")).toDF("a", "b")
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")
        )
        parent = materialize(parent)
        while True:  # until every parent is a root
            up = parent.select(F.col("node").alias("p_node"), F.col("root").alias("p_root"))
            jumped = materialize(
                parent.join(up, parent.root == up.p_node, "left").select(
                    "node", F.coalesce("p_root", "root").alias("root"), (F.col("p_root") < F.col("root")).alias("moved")
                )
            )
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("p_node"), F.col("root").alias("p_root"))
            found = materialize(
                found.join(up, found.root == up.p_node, "left").select("node", F.coalesce("p_root", "root").alias("root"))
            )
        near = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        far = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = materialize(
            ends.join(near, "a")
            .join(far, "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct()
        )
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
