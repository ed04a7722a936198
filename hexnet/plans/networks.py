"""Networks and way tables derived from the benchmark tables, in Spark SQL that DuckDB runs as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Cells in a row of the customer lattice.
WIDTH = 32


def lattice_sql(width: int = WIDTH) -> str:
    """src, dst, td, pref: customers on a hexagonal lattice, sparse and not symmetric."""
    return f"""
select src, dst, cast(td as double) td, cast(pref as double) pref from (
  select src, dst, td, pref, (src * 7 + dir * 13) % 10 < 6 keep from (
    select n.c_custkey src, n.c_custkey + d.step dst, d.dir dir, n.c_custkey % {width} q, 5 + cast(floor(abs(n.c_acctbal)) as bigint) % 60 td,
      case n.c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 4 else 8 end pref
    from customer n cross join (select 0 dir, 1 step union all select 1, {width} union all select 2, {width - 1}) d) a
  where not (dir = 0 and q = {width - 1}) and not (dir = 2 and q = 0)) b
where keep and dst in (select c_custkey from customer)
union all
select dst, src, cast(td as double), cast(pref as double) from (
  select src, dst, td, pref, (src * 7 + dir * 13) % 10 < 6 keep from (
    select n.c_custkey src, n.c_custkey + d.step dst, d.dir dir, n.c_custkey % {width} q, 5 + cast(floor(abs(n.c_acctbal)) as bigint) % 60 td,
      case n.c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 4 else 8 end pref
    from customer n cross join (select 0 dir, 1 step union all select 1, {width} union all select 2, {width - 1}) d) a
  where not (dir = 0 and q = {width - 1}) and not (dir = 2 and q = 0)) b
where keep and dst in (select c_custkey from customer) and (src + dst) % 5 <> 0"""


#: src, dst, td: suppliers that ship one after the other in an order; dense.
SHIPMENTS_SQL = """
select src, dst, min(td) td from (
  select l_suppkey src,
    lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) dst,
    1 + l_quantity td
  from lineitem) t
where dst is not null and src <> dst group by src, dst"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def lattice(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """The customer lattice with edge = src * 1000000 + dst and a length of one metre for each edge."""
    views(spark, sf_dir, "customer")
    return spark.sql(f"select src * 1000000 + dst edge, src, dst, td, pref, cast(1 as double) len_m from ({lattice_sql(width)}) e")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(f"select src * 1000000 + dst edge, src, dst, td, cast(0 as double) pref, cast(1 as double) len_m from ({SHIPMENTS_SQL}) e")
