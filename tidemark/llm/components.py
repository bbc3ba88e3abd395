"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id that each linked id is connected to.

    Every round each id takes the smallest label around it, then the label of that label, so distances
    shrink geometrically.  Neighbours' labels are pre-aggregated by min before their shuffle; the joins
    on a hot id are split by AQE.  Each round is a written table.
    """
    edges = links.select(F.col("a").alias("id"), F.col("b").alias("neighbour")).union(links.select("b", "a")).distinct()
    edges = written(edges, "edges")
    labels = written(edges.groupBy("id").agg(F.least(F.min("id"), F.min("neighbour")).alias("component")).withColumn("changed", F.lit(True)), "labels")
    for _ in range(max_rounds):
        if not labels.where("changed").limit(1).count():
            break
        around = edges.join(labels.select(F.col("id").alias("neighbour"), "component"), "neighbour").groupBy("id").agg(F.min("component").alias("around"))
        near = labels.join(around, "id").select("id", F.col("component").alias("old"), F.least("component", "around").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("jump"))
        labels = near.join(jump, "near").select("id", F.least("near", "jump").alias("component"), (F.least("near", "jump") < F.col("old")).alias("changed"))
        labels = written(labels, "labels")
    else:
        raise RuntimeError("components did not settle")
    return labels.select("id", "component")
