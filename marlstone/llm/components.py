"""Connected components by alternating large-star and small-star steps, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scope


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """A written table (node, comp) of every node of edges(a, b), bigint; comp is the component's smallest node.

    Each step is written out, so lineage does not grow. Neighbourhoods are only ever reduced to their minimum, never
    gathered, and minima are taken by task before the shuffle. The number of steps grows with the logarithm of the
    component sizes. Loops are ignored.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    with scope(edges.sparkSession) as keep:
        e = materialize(e, "edges")
        while True:
            state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if state == before:
                out = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select("v", "v").distinct().toDF("node", "comp"))
                out = materialize(out, "components")
                keep(out)
                return out
            before = state
            e = _small(_large(e).filter("u <> v").distinct()).filter("u <> v").distinct()
            e = materialize(e, "edges")
