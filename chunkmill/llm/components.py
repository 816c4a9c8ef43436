"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut


def components(links: DataFrame) -> DataFrame:
    """Rows (key, component) for each key in links (a, b): the least key that links reach.

    Each round a key takes the least label among its own and its neighbours', then its label's label, so labels travel
    twice as far each time; it ends when a round changes nothing. Labels are cut each round.
    """
    n = buckets(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both.repartition(n, "b"))
    labels = cut(both.groupBy(F.col("b").alias("key")).agg(F.least(F.min("a"), F.first("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(hop, "label", "left").select("key", "old", F.least("label", "far").alias("label")).repartition(n, "key"))
        if not new.where("label <> old").take(1):
            return new.select("key", F.col("label").alias("component"))
        labels = new.select("key", "label")
