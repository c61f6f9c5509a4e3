"""Connected components by hooking and pointer jumping over saved tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save


def _through(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace column by where mapping (node, label) sends it; what it doesn't name stays."""
    m = mapping.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return table.join(m, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_label", column)).drop("_node", "_label")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) of type long to (node, label): for each node that has an edge, the smallest node that it reaches.

    In each round every root with a smaller neighbour hooks onto the smallest
    one, chains of hooks are halved until they are stars, and the edges move to
    the roots. Each tree has two roots at least, so the roots halve at least.
    No edges give an empty table; edges from a node to itself are ignored.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = save(edges.select(low, high).where("a < b").distinct(), f"{name}_edges")
    labels = save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), f"{name}_nodes")
    while not edges.isEmpty():
        hooks = save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), f"{name}_hooks")
        while True:
            jumped = save(_through(hooks.withColumn("old", F.col("label")), "label", hooks), f"{name}_jumps")
            hooks = jumped.drop("old")
            if jumped.where("old != label").isEmpty():
                break
        labels = save(_through(labels, "label", hooks), f"{name}_labels")
        moved = _through(_through(edges, "a", hooks), "b", hooks)
        edges = save(moved.select(low, high).where("a < b").distinct(), f"{name}_edges")
    return labels
