"""Connected components of a link table, wholly as distributed joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, staged


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Every round each id takes the smallest label among its neighbours' (a partial aggregate, so a node with
    very many links costs one row per task) and then its label's label, so labels travel at least twice as
    far each round. A round ends in a table in the shared folder; no lineage grows.
    """
    edges = staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(F.col(b), F.col(a))).where("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    made = labels
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jumped"))
        lower = staged(lower.join(jump, "next").select("id", "old", F.least("next", "jumped").alias("component")), "labels")
        discard(made)
        made, labels = lower, lower.select("id", "component")
        if lower.where("old <> component").isEmpty():
            discard(edges)
            return labels
