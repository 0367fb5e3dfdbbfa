"""Connected components of an edge table by minimum labels and pointer jumping.

Each round is two joins and a pre-aggregated minimum; labels are written to the shared folder, so a
lost executor costs a task and lineage stays short.  Rounds go on until no label changes (about the
logarithm of the longest path).  Nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node that can be reached.

    An empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("other")), "v")
        lower = near.groupBy("u").agg(F.min("other").alias("other"))
        hooked = labels.join(lower, "u").select("u", F.col("root").alias("old"), F.least("root", "other").alias("mid"))
        # one jump: the label of the label, as it stood before this round
        up = labels.select(F.col("u").alias("mid"), F.col("root").alias("top"))
        moved = hooked.join(up, "mid").select("u", F.least("mid", "top").alias("root"), (F.least("mid", "top") != F.col("old")).alias("changed"))
        labels = stored(moved, "labels", replaces=labels)
        if not labels.filter("changed").limit(1).count():
            return labels.select(F.col("u").alias("node"), "root")
