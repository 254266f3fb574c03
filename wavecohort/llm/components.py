"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of the undirected ``links`` (a, b).

    Each round takes the least label among neighbours and then the label's own label, so that stars end in two rounds
    and chains in about log(length) rounds. Rounds are checkpointed in the shared folder; nothing is collected but a
    count. No links: no rows.
    """
    both = checkpointed(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).where("id <> other").distinct())
    # the first labels come from the neighbours directly
    label = checkpointed(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        # labels that have a smaller one themselves: a few, however large a component is
        up = label.select(F.col("component").alias("c")).distinct().join(label.select(F.col("id").alias("c"), F.col("component").alias("cc")), "c").where("cc < c")
        step = checkpointed(step.join(up, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), "was"))
        label = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return label
