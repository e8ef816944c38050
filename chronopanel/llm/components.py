"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.session import cut_lineage


def star_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round points a node's larger neighbours to its smallest one (large star), then does the same among the
    smaller ones (small star). Only minima are aggregated and joined back, so a hub is never gathered in one row, and
    the number of edges never grows. Rounds go on until the edge set stays the same; there is no round limit. Every
    round is written by a reliable checkpoint.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    print_ = _fingerprint(edges)
    while print_[0]:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        edges = cut_lineage(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
                            .union(small.select("hi", F.col("m").alias("lo"))).distinct())
        now = _fingerprint(edges)
        if now == print_:
            break
        print_ = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
                    F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
    return row["n"], row["h"], row["x"]
