"""Connected components of a link table, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the smallest label of a node's neighbours, then that label's own label, so that labels travel twice as
    far each time. Labels are written after each round; both sides of every join are tables, which adaptive execution
    may split where one node has many links. Null ends are ignored, loops and repeated links do no harm.
    """
    ends = links.where("a is not null and b is not null").select("a", "b")
    ends = written(ends.union(ends.select("b", "a")).distinct(), "ends")
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(most_rounds):
        heard = ends.join(labels, ends["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        nearer = written(labels.union(heard).groupBy("node").agg(F.min("label").alias("label")), "labels")
        further = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(nearer.join(further, "label").select("node", F.col("next").alias("label")), "labels")
        moved = after.select("node", F.col("label").alias("new")).join(labels, "node").where("new < label").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")
