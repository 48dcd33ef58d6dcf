"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a minimum per node and a join; links first shrink to a spanning forest inside every partition.
Every step is written to the shared folder, so lost executors cost one step at most, and nothing but whether
all components are stars reaches the driver. A node with a million links is a partial minimum and a join that Spark
can split. Null ends and self-links are ignored; repeated links count once; no links give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import ship, stage


#: nodes that a task holds at once; beyond, it sends its forest so far and starts another
_HELD = 1 << 18


def _forest(batches):
    """Every node of one partition's links with the smallest node of its local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent[root]) != root:
            root = p
        while (p := parent[x]) != root:
            parent[x], x = root, p
        return root

    def ends():
        found = np.array([(x, find(x)) for x in parent], np.int64).reshape(-1, 2)
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["hi", "lo"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > _HELD:
            yield ends()
    yield ends()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, or is the smaller end of all of its links."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node it is connected to."""
    ship(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = stage(pairs.mapInArrow(_forest, "hi long, lo long").where("hi <> lo").distinct(), "components-links")
    while not _stars(edges):
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, "components-large")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        edges = stage(small, "components-small")
    return edges.union(edges.select("lo", "lo").distinct()).toDF("node", "component")
