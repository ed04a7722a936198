"""Contraction: a shortcut over each chain of edges without a choice on the way.

An edge a -> b heads a chain unless exactly one other edge comes into a (from a cell that isn't b).  A
chain goes on from b while exactly one edge leaves b that doesn't lead straight back.  Chains of min_len
edges or more become shortcuts beside their first edge; single edges stay.

Chains are built by doubling: round n knows the edge 2**n steps behind every edge, and adds as many edges
to every head's chain.  Rows are edges of chains, so no row grows with a chain while it is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TooShortShortcut
from ..functions import weights
from ..plans.store import Rounds

DEFAULT_MIN_LEN = 4


def heads(edges: DataFrame) -> DataFrame:
    """edge of those that head a chain."""
    into = edges.select(F.col("src").alias("x"), F.col("dst").alias("a"))
    own = edges.select("edge", "src", "dst")
    counted = own.join(into, own["src"] == into["a"], "left").groupBy("edge").agg(F.count(F.when(F.col("x") != F.col("dst"), 1)).alias("n"))
    return counted.where("n <> 1").select("edge")


def onward(edges: DataFrame) -> DataFrame:
    """edge, next: the only edge that leaves its end other than straight back."""
    out = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("edge").alias("next"))
    own = edges.select("edge", "src", "dst")
    pairs = own.join(out, own["dst"] == out["b"]).where("c <> src")
    return pairs.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")).where("n = 1").select("edge", "next")


def chains(edges: DataFrame) -> DataFrame:
    """edge (a head), path (ids of its chain's edges in order, the head first).  Runs jobs.

    A chain stops before an edge that it holds already.
    """
    spark = edges.sparkSession
    jumps, kept = Rounds(spark), Rounds(spark)
    jump = jumps.write(onward(edges))
    rows = kept.write(heads(edges).select(F.col("edge").alias("head"), F.lit(0).alias("pos"), "edge", F.lit(True).alias("open")))
    step = 1
    while True:
        grown = rows.where("open").join(jump, "edge").select("head", (F.col("pos") + step).alias("pos"), F.col("next").alias("edge"), "open")
        if not grown.limit(1).count():
            break
        seen = F.row_number().over(Window.partitionBy("head", "edge").orderBy("pos"))
        again = F.min(F.when(F.col("seen") > 1, F.col("pos"))).over(Window.partitionBy("head"))
        both = rows.unionByName(grown).withColumn("seen", seen).withColumn("again", again)
        rows = kept.write(both.where("again is null or pos < again").select("head", "pos", "edge", (F.col("open") & F.col("again").isNull()).alias("open")))
        jump = jumps.write(jump.join(jump.select(F.col("edge").alias("next"), F.col("next").alias("beyond")), "next").select("edge", F.col("beyond").alias("next")))
        step *= 2
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge"))), lambda x: x["edge"])
    return rows.groupBy(F.col("head").alias("edge")).agg(path.alias("path"))


def contract(edges: DataFrame, min_len: int = DEFAULT_MIN_LEN, standard: bool = True) -> DataFrame:
    """The edges with a column ff: the shortcut that an edge heads, or null.  Runs jobs."""
    if min_len < 3:
        raise TooShortShortcut(f"shortcuts need 3 edges or more, not {min_len}")
    long = chains(edges).where(F.size("path") >= min_len)
    each = long.select(F.col("edge").alias("head"), F.posexplode("path").alias("pos", "edge")).join(edges.select("edge", "dst", "td", "pref"), "edge")
    grouped = each.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "edge", "dst", "td", "pref"))).alias("s"))
    w = F.transform("s", lambda x: F.struct(x["td"].alias("td"), x["pref"].alias("pref")))
    folded = weights.fold(w) if standard else F.struct(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["td"]).alias("td"), F.lit(0.0).alias("pref"))
    ff = grouped.withColumn("w", folded).select(
        F.col("head").alias("edge"),
        F.struct(
            F.col("s.edge").alias("edges"), F.col("s.dst").alias("cells"), F.element_at("s", -1)["dst"].alias("dst"), F.col("w.td").alias("td"), F.col("w.pref").alias("pref")
        ).alias("ff"),
    )
    return edges.drop("ff").join(ff, "edge", "left")


def non_overlapping(contracted: DataFrame) -> DataFrame:
    """The edges that no shortcut passes over, besides those that head one."""
    inside = contracted.where("ff is not null").select(F.posexplode("ff.edges").alias("pos", "edge")).where("pos > 0").select("edge").distinct()
    return contracted.join(inside, "edge", "left_anti")
