"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> one row a node that has an edge: (node, root), the
    root being the least node of its component.

    A round takes the least label around every node and then the label of that
    label.  Sums are combined map-side, so a node with very many edges is not
    gathered in one task; each round's labels are written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = cut(both, "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "cc-labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near")))
        stepped = labels.join(near, labels["node"] == near["a"], "left") \
            .select("node", "root", F.least("root", "near").alias("least"))
        up = labels.select(F.col("node").alias("u"), F.col("root").alias("u_root"))
        jumped = stepped.join(up, stepped["least"] == up["u"], "left") \
            .select("node", F.least("least", "u_root").alias("root"), (F.least("least", "u_root") < F.col("root")).alias("moved"))
        jumped = cut(jumped, "cc-labels")
        if jumped.filter("moved").isEmpty():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
