"""Datasets keyed by cell, stored by coarse cell."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument, UnidentifiedFileFormat, UnsupportedResolution
from ..operators.enrich import need

PARTITION = "file_cell"
#: Formats by file extension.
FORMATS = {"arrow": "ipc", "ipc": "ipc", "feather": "ipc", "parquet": "parquet", "pq": "parquet"}


def format_of(name: str) -> str:
    """ipc or parquet, by the extension."""
    kind = name.strip().lower().rpartition("/")[2].rpartition(".")
    if not kind[1] or kind[2] not in FORMATS:
        raise UnidentifiedFileFormat(name)
    return FORMATS[kind[2]]


def key_of(pattern: str, **values: object) -> str:
    """A key from a pattern with {data_h3_resolution}, {file_h3_resolution} and {h3cell}; spaces inside braces are allowed."""

    def value(m: re.Match) -> str:
        if m[1] not in values:
            raise InvalidArgument(f"{m[1]!r} in {pattern!r}")
        return str(values[m[1]])

    return re.sub(r"\{\s*(\w+)\s*\}", value, pattern)


@dataclass(frozen=True)
class Dataset:
    """path: of the Parquet table, or with a key_pattern the root of its files.  resolutions: of the data -> of the files."""

    path: str
    resolutions: dict[int, int]
    cell_column: str = "h3index"
    key_pattern: str = ""
    schema: str = ""
    extra: dict = field(default_factory=dict)

    def file_resolution(self, data_resolution: int) -> int:
        if data_resolution not in self.resolutions:
            raise UnsupportedResolution(f"resolution {data_resolution} isn't one of {sorted(self.resolutions)}")
        return self.resolutions[data_resolution]

    def write(self, df: DataFrame, parent: Callable[[Column], Column], data_resolution: int) -> None:
        """Writes the rows in folders by the coarse cell; a folder's rows come from a few tasks, however many it has."""
        self.file_resolution(data_resolution)
        placed = need(df, self.cell_column).withColumn(PARTITION, parent(F.col(self.cell_column)))
        placed.hint("rebalance", PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(f"{self.path}/{data_resolution}")

    def read(self, spark: SparkSession, data_resolution: int, cells: DataFrame | None = None, parent: Callable[[Column], Column] | None = None, cell: str = "cell") -> DataFrame:
        """All rows, or those of the cells given: only the folders of their coarse cells are read.

        A folder that is missing is empty.  Without cells of the table the result is empty.
        """
        file_resolution = self.file_resolution(data_resolution)
        if self.key_pattern:
            path = f"{self.path}/{key_of(self.key_pattern, data_h3_resolution=data_resolution, file_h3_resolution=file_resolution, h3cell='*')}"
            if format_of(path) == "parquet":
                rows = spark.read.parquet(path)
            else:
                from .graphs import read_ipc

                rows = read_ipc(spark, path, self.schema)
            rows = need(rows, self.cell_column)
            if cells is None:
                return rows
            own = cells.select(F.col(cell).cast("long").alias("__c")).distinct()
            return rows.join(own, rows[self.cell_column] == own["__c"], "left_semi")
        rows = need(spark.read.parquet(f"{self.path}/{data_resolution}"), self.cell_column)
        if cells is None:
            return rows.drop(PARTITION)
        wanted = cells.select(F.col(cell).cast("long").alias("__c")).distinct()
        # the join on the folder's column lets Spark prune folders while it runs
        both = wanted.withColumn("__f", parent(F.col("__c")))
        return rows.join(both, (rows[self.cell_column] == both["__c"]) & (rows[PARTITION] == both["__f"]), "left_semi").drop(PARTITION)
