"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import durable, forget


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for every id that has a link.

    Each round takes the least label among the neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest chain.  Only a count reaches the driver.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("id"), F.least("a", "_m").alias("component")))
    table = labels
    while True:
        of = labels.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
        near = both.join(of, F.col("b") == F.col("_id")).groupBy("a").agg(F.min("_c").alias("_near"))
        lower = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = lower.join(of, F.col("_new") == F.col("_id"), "left")
        after = durable(jump.select("id", "_old", F.least("_new", F.coalesce("_c", "_new")).alias("component")))
        forget(table)
        table, labels = after, after.select("id", "component")
        if after.where("component <> _old").isEmpty():
            forget(both)
            return labels
