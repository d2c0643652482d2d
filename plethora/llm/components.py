"""Connected components of an edge table, as DataFrame rounds over tables in the shared folder.

Each round every node takes the least label among its neighbours', hooks its old root to it, and jumps to its label's
label; components of n nodes take about log n rounds. Nothing but a flag reaches the driver. Labels are broadcast while they
are few, and dealt out as tables beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import FEW, settled, staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, comp: the least node that is reachable, for every node that has an edge. Only the last labels stay in the shared folder."""
    return settled(edges.sparkSession, "components", lambda: _labels(edges))


def _labels(edges: DataFrame) -> DataFrame:
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    label = staged(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("comp")), "labels")
    short = F.broadcast if label.count() <= FEW else lambda table: table  # the nodes stay the same from round to round
    while True:
        other = label.select(F.col("node").alias("v"), F.col("comp").alias("near"))
        nearest = both.join(short(other), "v").groupBy("u").agg(F.min("near").alias("near"))
        told = label.join(nearest, F.col("node") == F.col("u")).select("node", "comp", F.least("comp", "near").alias("near"))
        # was: the label before; only the node's own row carries it.
        rows = told.select("node", F.col("near").alias("to"), F.col("comp").alias("was")).union(told.select(F.col("comp"), F.col("near"), F.lit(None).cast(label.schema["comp"].dataType)))
        hooked = staged(rows.groupBy("node").agg(F.min("to").alias("to"), F.max("was").alias("was")), "hooked")
        # Soon most nodes of a component name the same one: both sides are tables, so that its partition can be split.
        root = hooked.select(F.col("node").alias("r_node"), F.col("to").alias("r_to"))
        jumped = hooked.join(short(root), F.col("to") == F.col("r_node"), "left").select("node", F.least("to", "r_to").alias("comp"), "was")
        jumped = staged(jumped, "labels")
        label = jumped.select("node", "comp")
        if jumped.where(F.col("comp") != F.col("was")).isEmpty():
            return label
