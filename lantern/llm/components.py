"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import remove, scratch


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable from it, for edges (a long, b long).

    Each round gives every node the smallest label among its neighbours' and its own, and then the label of that label, so
    that paths halve. Rounds end when no label changes. Labels go through tables in the shared folder; nulls and loops
    are no edges, and an empty table gives an empty one.
    """
    spark = edges.sparkSession
    good = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    paths = [scratch(spark, "edges"), scratch(spark, "labels")]
    good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(paths[0])
    both = spark.read.parquet(paths[0])
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")).write.parquet(paths[1])
    while True:
        labels = spark.read.parquet(paths[-1])
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = step.join(jump, "next").select("node", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("changed"))
        paths.append(scratch(spark, "labels"))
        step.write.parquet(paths[-1])
        done = spark.read.parquet(paths[-1]).where("changed").isEmpty()
        remove(spark, paths[-2])
        if done:
            return spark.read.parquet(paths[-1]).select("node", "component")
