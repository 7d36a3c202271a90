"""Connected components: union-find inside partitions, star rounds between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def _forest(batches):
    """Union-find over the edges of a partition: each node with its root, where they differ."""
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for low in range(0, len(nodes), 100_000):
        part = nodes[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of the component.

    Nodes are of any type that Spark and Python order alike: integers, strings, dates.
    Self-loops, repeated and reversed edges are allowed; no edges give no rows.  Every
    round ends in the shared folder.  The rounds are few: their number grows with the
    logarithm of the longest path.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    kind = edges.schema["a"].dataType.simpleString()
    alone = edges.where("a = b")
    forest = cut(edges.where("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}").where("a <> b"))
    seen = None
    while True:
        state = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # large star: each node hangs its greater neighbours on the least of them all
        both = forest.select("a", "b").union(forest.select("b", "a")).toDF("u", "v")
        both = both.select("u", "v", F.least("u", F.expr("min(v) over (partition by u)")).alias("m"))
        large = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: each node hangs its lesser neighbours, and itself, on the least of them
        down = large.distinct().select("a", "b", F.expr("min(b) over (partition by a)").alias("m"))
        small = down.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        forest = cut(small)
    roots = forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = forest.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = roots.union(tops)
    solo = alone.select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return found.union(solo)
