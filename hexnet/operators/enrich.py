"""Joining results with datasets keyed by cell, and preparing such datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingCellColumn


#: Rows of a dataset that are broadcast.
MOST_SENT = 200_000


def need(df: DataFrame, column: str) -> DataFrame:
    """The frame with its cell column as long, or MissingCellColumn."""
    if column not in df.columns:
        raise MissingCellColumn(f"no column {column!r} among {df.columns}")
    return df.withColumn(column, F.col(column).cast("long"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with a prefix, whatever their names are."""
    return df.toDF(*(prefix + c for c in df.columns))


def enrich(left: DataFrame, key: str, right: DataFrame, right_key: str, prefix: str = "") -> DataFrame:
    """Inner join on left.key = right.right_key; right's columns get the prefix, its key goes."""
    right = need(right, right_key)
    at = "__key"
    while at in left.columns or prefix + at in left.columns:
        at += "_"
    side = right.withColumn(at, F.col(right_key)).drop(right_key)
    side = side.toDF(*(c if c == at else prefix + c for c in side.columns))
    return left.join(side, left[key] == side[at]).drop(at)


def members(cells: DataFrame, dataset: DataFrame, dataset_key: str, cell: str = "cell") -> DataFrame:
    """The cells that a dataset has."""
    known = need(dataset, dataset_key).select(F.col(dataset_key).alias("__m"))
    return cells.join(known, cells[cell] == known["__m"], "left_semi")


def few(dataset: DataFrame, dataset_key: str, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """The dataset's rows for some cells, as a side to join with rows whose number Spark doesn't know: broadcast if they are few, else built in parts.

    Results of a search come from a few rows by Spark's estimate, which would send all of them to the driver.
    """
    known = cells.select(F.col(cell).cast("long").alias("__m")).distinct()
    right = need(dataset, dataset_key)
    out = right.join(known, right[dataset_key] == known["__m"], "left_semi")
    return F.broadcast(out) if out.limit(MOST_SENT + 1).count() <= MOST_SENT else out.hint("shuffle_hash")


def outside(cells: DataFrame, hidden: DataFrame, cell: str = "cell") -> DataFrame:
    own = hidden.select(F.col(cell).alias("__m"))
    return cells.join(own, cells[cell] == own["__m"], "left_anti")


def roll_up(df: DataFrame, cell: str, parent: Callable[[Column], Column], *values: str) -> DataFrame:
    """Sums of the values by the cells' parents."""
    return df.groupBy(parent(F.col(cell)).alias(cell)).agg(*(F.sum(v).alias(v) for v in values))


def outer_merge(frames: list[DataFrame], cell: str) -> DataFrame:
    """All cells of several datasets with the columns of each, null where it hasn't the cell."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, cell, "full_outer")
    return out
