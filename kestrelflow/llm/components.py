"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import lookup, packed, settled


def connected_components(links: DataFrame) -> DataFrame:
    """Each end of the links (a, b: long) with the smallest id it reaches, as (node, component).

    Every round hangs larger neighbours on the smallest one (first from each node's larger side,
    then from its smaller side) until all links are stars. Minima come from aggregation and a join, so no
    node's neighbour list is ever gathered; nodes of many links are joined by a broadcast. Loops and
    nulls are ignored; no links give no rows.
    """
    edges = settled(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    total = 2 * edges.count()
    edges = packed(edges, total)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(settled(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("members"))), total)
        large = lookup(both.where("v > u"), least, "u", "members", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")  # repeated links do no harm here
        least = packed(settled(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members"))), total)
        hung = lookup(large, least, "u", "members", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = packed(settled(hung.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()), total)
        total = 2 * edges.count()
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node, or has only larger ones hanging on it: then those are the components."""
    ends = edges.select("u", "v", F.lit(False).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("centre")))
    nodes = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("centre").alias("centre"))
    return nodes.where("lo <> hi or centre and lo is not null").isEmpty()
