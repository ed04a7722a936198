"""Persisted networks: Parquet tables and Arrow IPC files, found by name and resolution.

    edge, edge_preference, edge_travel_duration, long_edge (list), long_edge_preference,
    long_edge_travel_duration, and src, dst, len_m beside them, as an edge id alone doesn't tell its end
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators.graph import check
from ..plans.store import ship

SCHEMA = (
    "edge long, src long, dst long, len_m double, edge_preference float, edge_travel_duration float, "
    "long_edge array<long>, long_cells array<long>, long_edge_preference float, long_edge_travel_duration float"
)
_NAME = re.compile(r"^(?P<name>.+)_(?P<res>[0-9]+)(?:\.(?:ipc|arrow|parquet))?$")


@dataclass(frozen=True, order=True)
class GraphKey:
    """A network's name and resolution; its text is NAME_RESOLUTION."""

    name: str
    resolution: int

    @classmethod
    def parse(cls, text: str) -> GraphKey:
        m = _NAME.match(text.rstrip("/").rpartition("/")[2])
        if not m or not 0 <= int(m["res"]) <= 15:
            raise InvalidArgument(f"{text!r} isn't NAME_RESOLUTION")
        return cls(m["name"], int(m["res"]))

    def __str__(self) -> str:
        return f"{self.name}_{self.resolution}"


def write(edges: DataFrame, path: str) -> None:
    """Writes a network, with its shortcuts, as zstd Parquet, sorted by source within files."""
    ff = F.col("ff") if "ff" in edges.columns else F.lit(None).cast("struct<edges:array<bigint>,cells:array<bigint>,dst:bigint,td:double,pref:double>")
    out = edges.select(
        "edge", "src", "dst", "len_m", F.col("pref").cast("float").alias("edge_preference"), F.col("td").cast("float").alias("edge_travel_duration"),
        ff["edges"].alias("long_edge"), ff["cells"].alias("long_cells"), ff["pref"].cast("float").alias("long_edge_preference"), ff["td"].cast("float").alias("long_edge_travel_duration"),
    )
    out.sortWithinPartitions("src").write.mode("overwrite").option("compression", "zstd").parquet(path)


def from_table(table: DataFrame) -> DataFrame:
    """Rows of the persisted form as edges; rows without an edge or a weight go; an incomplete shortcut is none."""
    whole = F.col("long_edge").isNotNull() & (F.size("long_edge") > 0) & F.col("long_edge_preference").isNotNull() & F.col("long_edge_travel_duration").isNotNull()
    ff = F.when(whole, F.struct(
        F.col("long_edge").alias("edges"), F.col("long_cells").alias("cells"), F.element_at("long_cells", -1).alias("dst"),
        F.col("long_edge_travel_duration").cast("double").alias("td"), F.col("long_edge_preference").cast("double").alias("pref"),
    ))
    rows = table.where("edge is not null and edge_preference is not null and edge_travel_duration is not null")
    return rows.select("edge", "src", "dst", F.col("edge_travel_duration").cast("double").alias("td"), F.col("edge_preference").cast("double").alias("pref"), "len_m", ff.alias("ff"))


def read(spark: SparkSession, path: str, resolution=None) -> DataFrame:
    """A network as written; EmptyGraph or MixedResolutions (of a resolution expression of cells) if it isn't one."""
    return check(from_table(spark.read.schema(SCHEMA).parquet(path)), resolution)


def read_ipc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files (the file or the stream form) of any store that Spark reads; columns by name, missing ones null."""
    ship(spark)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    target = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data = pa.BufferReader(content.as_buffer())
                try:
                    reader = pa.ipc.open_file(data)
                    parts = (reader.get_batch(k) for k in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    data.seek(0)
                    parts = iter(pa.ipc.open_stream(data))
                for part in parts:
                    have = set(part.schema.names)
                    columns = [part[n].cast(target.field(n).type, safe=False) if n in have else pa.nulls(part.num_rows, target.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def to_ipc_chunks(df: DataFrame, rows: int = 3000) -> Iterator[bytes]:
    """The rows as Arrow IPC files of at most so many rows, one partition at a time; none for an empty frame."""
    names, held = df.columns, []
    kinds = df.limit(0).toArrow().schema

    def chunk(some: list) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.table({n: pa.array([r[n] for r in some], kinds.field(n).type) for n in names})
        with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield chunk(held)
            held = []
    if held:
        yield chunk(held)


def concat_chunks(chunks: Iterator[bytes]) -> pa.Table | None:
    """What a client makes of the chunks; None for none."""
    tables = [pa.ipc.open_file(c).read_all() for c in chunks]
    return pa.concat_tables(tables) if tables else None


def list_graphs(spark: SparkSession, prefix: str) -> list[GraphKey]:
    """The networks in a folder, of any store; names of other forms are passed over."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(prefix)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = []
    for status in store.listStatus(path):
        try:
            found.append(GraphKey.parse(status.getPath().getName()))
        except InvalidArgument:
            continue
    return sorted(found)
