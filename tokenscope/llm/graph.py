"""Connected components of links in DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenscope.llm.common import map_batches, release


def _forest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The links of one batch as links of each node to the least node of its component there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    some = [(x, find(x)) for x in parent if parent[x] != x]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], type=pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node, label being the least node of its component; links has a, b.

    Links are first contracted within each batch. Then large-star and small-star steps take turns: each joins a node's
    neighbours to the least of them. Only minima are gathered per node, and they are written before the joins that
    bring them back, so that adaptive execution can split the rows of a node with very many links.
    """
    spark = links.sparkSession
    edges = map_batches(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), _forest, "u long, v long").distinct().checkpoint()
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        joined = large.join(small_least, "u")
        edges = (
            joined.select("u", F.col("m").alias("v"))
            .union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
            .checkpoint()
        )
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(spark)
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
