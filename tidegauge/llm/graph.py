"""Connected components on DataFrames, for links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long). Returns (id, component): for each id in a link, the smallest id that it reaches.

    Each round, every id takes the smallest label around it and then that label's own label, which halves
    the distance to the smallest; the rounds end when no label changes. Labels are cut into the shared folder.
    """
    both = table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(around, labels["id"] == around["a"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("id").alias("_j"), F.col("component").alias("_c"))
        new = table(step.join(jump, step["c"] == jump["_j"], "left").select("id", "old", F.least("c", F.coalesce("_c", "c")).alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
