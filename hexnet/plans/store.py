"""What executors need of the driver: this package, and tables in a shared folder that cut lineage between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on a single machine where it is unset, a folder made here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise InvalidArgument("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="hexnet-shared-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "hexnet_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


class Rounds:
    """Written tables of an iteration: each round's is read by the next, and the one before is deleted."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/round-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            self._delete(self.paths.pop(0))
        return self.spark.read.schema(schema).parquet(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
