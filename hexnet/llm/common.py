"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import store

#: Rows in an Arrow batch.  Documents may be long, so batches are small.
BATCH_ROWS = 1000
#: Bytes in an Arrow batch.
BATCH_BYTES = 32 << 20


def ready(spark: SparkSession) -> None:
    """Sends this package to the Python workers and bounds the batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    store.ship(spark)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{store.shared_dir(spark)}/hexnet-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, in a folder for each value of ``by``, and reads it again: the lineage
    is cut and lost executors lose nothing.  What is left at the end of the application is deleted then.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def drop(written: DataFrame, folder: str = "") -> None:
    """Deletes what ``materialize`` has written, or one folder of it, once nothing reads it any more."""
    spark = written.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{written._written_at}/{folder}".rstrip("/"))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n.  Null for a null id."""
    return (F.crc32(doc_id.cast("string")) % n).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once_per_id(labels: DataFrame, column: str) -> DataFrame:
    """One label per document: the larger where repeated rows differ; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column)).cast("int").alias("label"))
    )


def sample(rows: DataFrame, by: str, per: int, most: int = 1000, total: int | None = None) -> DataFrame:
    """About ``per`` rows of each value of ``by``, all where there are fewer: those whose hashed doc_id is
    below the share wanted.  The same rows are chosen however the table is dealt, and no group of rows
    meets in one task.  Only the ``most`` frequent values are taken (their counts come to the driver), and fewer rows of
    each where there would be more than ``total``.
    """
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(most).collect()
    per = min(per, total // max(1, len(counts))) if total else per
    wanted = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    for r in counts:
        wanted = wanted | ((F.col(by) == r[by]) & (place < F.lit(int((1 << 30) * min(1.0, per / r["count"])))))
    return rows.where(wanted)


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, keep: Column, per_class: int, longest: int, chars: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of about per_class labelled documents of each label, written to the shared folder.

    Documents of more than ``longest`` characters are no examples; where a label's examples have more than ``chars``
    characters in all, fewer are taken, so the sample is bounded in bytes too.
    """
    label = F.least(F.greatest(F.col("label"), F.lit(0)), F.lit(1)).alias("label")
    ids = sample(once_per_id(labels, column).where(keep).select("doc_id", label), "label", per_class)
    rows = documents.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    chosen = materialize(rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "sample")
    share = {r["label"]: r["n"] or 0 for r in chosen.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(1 << 30))
    for k, n in share.items():
        if n > chars:
            chosen = chosen.where((F.col("label") != k) | (place < int((1 << 30) * chars / n)))
    return chosen
