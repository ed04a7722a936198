"""Changes of edge weights from a stream, kept as the latest state of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

UPDATE = "edge long, src long, dst long, td double, pref double, len_m double, at timestamp"


def apply(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """The edges with the latest update of each; a null td closes an edge; updates of new edges add them."""
    w = Window.partitionBy("edge").orderBy(F.desc("at"), "td", "pref")
    last = updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    kept = edges.select("edge", "src", "dst", "td", "pref", "len_m").join(last.select("edge"), "edge", "left_anti")
    return kept.unionByName(last.where("td is not null").select(kept.columns))


def latest(updates: DataFrame, delay: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """A streaming frame of the mean weights of each edge and window; late updates are dropped after the delay."""
    windows = updates.withWatermark("at", delay).groupBy(F.window("at", every), "edge")
    return windows.agg(F.avg("td").alias("td"), F.avg("pref").alias("pref"), F.count(F.lit(1)).alias("n")).select("window.start", "edge", "td", "pref", "n")


def maintain(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of updates to the network at path, as a new version beside the old one.

    A version is a folder path/v=<batch>; a batch that is run again writes the same folder, and readers
    take the largest.  The caller writes path/v=-1 first.
    """

    def batch(some: DataFrame, n: int) -> None:
        spark = some.sparkSession
        before = spark.read.parquet(f"{path}/v={current(spark, path, n)}")
        apply(before, some).write.mode("overwrite").parquet(f"{path}/v={n}")

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, below: int | None = None) -> int:
    """The newest version, or the newest below a number."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[2:]) for s in store.listStatus(p) if s.getPath().getName().startswith("v=")]
    return max(v for v in found if below is None or v < below)
