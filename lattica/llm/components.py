"""Connected components of a link table as a Spark loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, kept


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in ``links``; component_id is the smallest id that can be reached.

    Each round gives a vertex the smallest label among itself and its neighbours (an aggregation with map-side
    combining, so a hub costs one row per task) and then follows label to label once, which roughly doubles
    the distance covered.  Rounds are written to the shared folder: a lost executor repeats one round at most,
    and a round's tables go when the next one is written.  Both inputs of each join are plain tables, so that
    Spark can split a hot key.  Links with a null end and self-links are ignored; an empty table gives an empty
    result.
    """
    one = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = kept(one.union(one.select("dst", "src")).distinct())
    labels = kept(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
                  .select("id", F.least("id", "m").alias("label")))
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("src"), "label"), "src")
            .select(F.col("dst").alias("id"), "label").union(labels.select("id", "label"))
            .groupBy("id").agg(F.min("label").alias("label"))
        )
        near = kept(near)
        hop = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = kept(near.join(hop, "label").select("id", F.col("far").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        discard(near, labels)
        labels = new
        if not changed:
            discard(both)
            return labels.select("id", F.col("label").alias("component_id"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
