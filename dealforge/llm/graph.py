"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every end of an edge; the component is its smallest node.

    Labels spread over the edges and then jump to their label's label, so the rounds grow with the
    logarithm of a component's diameter. Each round is a table in the shared folder, of which the last
    stays. Rows with a null end are left out.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = saved(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    lone = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).where("node is not null")
    label = lone.unionByName(both.select(F.col("u").alias("node"))).select("node", F.col("node").alias("label")).distinct()
    twoway = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = twoway.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    label = label.join(first, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
    label = old = saved(label, "labels")
    while True:
        near = twoway.join(label.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("m"))
        spread = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("new"), F.col("label").alias("old"))
        spread = saved(spread, "labels")
        heads = spread.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        after = saved(spread.join(heads, "new").select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("old")).alias("moved")), "labels")
        discard(old, spread)
        old, label = after, after.select("node", "label")
        if after.where("moved").limit(1).count() == 0:
            return label.select("node", F.col("label").alias("component"))
