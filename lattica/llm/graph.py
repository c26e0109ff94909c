"""Connected components of a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, drop_shuffles


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of links (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours and hands it to the node that
    its old label names, so that all who bear that label follow; then it takes the label of its
    label. Rounds go on until no label changes: then neighbours have equal labels, and as labels
    are nodes of the component and only get smaller, that label is its smallest node. Labels are
    written each round, so lineage stays short and lost executors cost a round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.write(both, f"{name}-links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    for k in itertools.count(1):
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("next"))
        handed = step.where("next < label").select(F.col("label").alias("node"), F.lit(None).cast(step.schema["label"].dataType).alias("label"), "next")
        step = step.unionByName(handed).groupBy("node").agg(F.max("label").alias("label"), F.min("next").alias("next"))
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("further"))
        step = step.join(jump, F.col("next") == F.col("at")).select("node", F.least("next", "further").alias("next"), "label")
        new = scratch.write(step, f"{name}-{k}")
        same = new.where("next != label").limit(1).count() == 0
        labels = new.select("node", F.col("next").alias("label"))
        scratch.drop(f"{name}-{k - 1}")
        if same:
            break
        if k % 4 == 0:
            drop_shuffles(scratch.spark)
    scratch.drop(f"{name}-links")
    return labels.withColumnRenamed("label", "component")
