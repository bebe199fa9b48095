"""Connected components of a graph of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of ``links`` (a, b).

    A link with a null end, or from a vertex to itself, links nothing; without links there are no rows.
    Each round gives a vertex the smallest label around it and then the label of that
    label (pointer jumping), so the rounds grow with the logarithm of the longest path.
    Labels are written to the shared folder each round: lost executors cost one round.
    Messages are combined before they are shuffled, so a vertex of high degree is one row
    per task.
    """
    with scratch() as keep:
        both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
        labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component"), F.lit(None).cast("long").alias("was")))
        while True:
            of = labels.select(F.col("v").alias("u"), F.col("component").alias("jump"))
            near = both.join(of, F.col("b") == F.col("u")).groupBy("a").agg(F.min("jump").alias("around"))
            least = labels.join(near, F.col("v") == F.col("a")).select("v", F.least("component", "around").alias("component"), F.col("component").alias("was"))
            now = written(least.join(of, F.col("component") == F.col("u"), "left").select("v", F.least("component", F.coalesce("jump", "component")).alias("component"), "was"))
            if now.where("component <> was").isEmpty():
                found = now.select("v", "component")
                found.written_to = now.written_to
                return keep(found)
            labels = now
