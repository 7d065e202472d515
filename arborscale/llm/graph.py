"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of the links.

    Each round every node takes the least label next to it and then the label of its label, so long chains halve;
    rounds end when no label changes. Each round is written, so lineage stays short."""
    edges = links.select(F.col(left).alias("node"), F.col(right).alias("to"))
    edges = written(edges.union(edges.select("to", "node")).where("node <> to").distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")), "labels")
    while True:
        told = edges.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("told"))
        near = labels.join(told, "node").select("node", "label", F.least("label", "told").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = written(near.join(jump, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")), "labels")
        discard(labels)
        labels = step
        if step.where("changed").isEmpty():
            discard(edges)
            return step.select("node", "label")
