"""How the jobs are bound to the given tables, in Spark and in the SQL they are compared with.

A group is an order, its members are parts; a run is a line item of a part that occurs once in its order. Entities are
the part, the supplier and the customer; the day is the order's date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastmark.operators.quality import singletons

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by the name of their function, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return add


#: Bytes of rows in memory for a byte of Parquet files, at least.
FILE_FACTOR = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Spark takes the bytes of its files for those of its rows and would broadcast a table of sorted keys
    that is many times as large in the driver's memory, so the session is told what a byte of a file stands for."""
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < FILE_FACTOR:
        spark.conf.set(factor, FILE_FACTOR)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = singletons(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(
        F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("sup"), F.col("o_custkey").alias("own"),
        F.to_date("o_orderdate").alias("d"), (F.col("l_returnflag") == "R").alias("hit"), (F.col("l_linestatus") == "F").alias("fin"),
        F.col("l_quantity").cast("int").alias("rating"), F.col("l_discount").alias("weight"), F.col("l_extendedprice").alias("t"), F.col("l_tax").alias("tax"),
        F.col("c_nationkey").alias("venue"), F.col("p_size").alias("dist"), F.col("o_orderpriority").alias("pool"),
    )


def placed(df: DataFrame) -> DataFrame:
    """With `rk`, the place in the group by price, ties by member."""
    return df.withColumn("rk", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("t"), "member")))


RUNS = """
one AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n_same FROM lineitem),
runs0 AS (SELECT l_orderkey AS grp, l_partkey AS member, l_suppkey AS sup, o_custkey AS own, CAST(o_orderdate AS DATE) AS d,
  l_returnflag = 'R' AS hit, l_linestatus = 'F' AS fin, CAST(l_quantity AS INTEGER) AS rating, l_discount AS weight,
  l_extendedprice AS t, l_tax AS tax, c_nationkey AS venue, p_size AS dist, o_orderpriority AS pool
  FROM one JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE n_same = 1),
runs AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t DESC, member) AS rk FROM runs0)
"""

#: Predictions of a fixed formula, so both sides have the same numbers and no model is in between.
PREDS = RUNS + """,
preds AS (SELECT grp, member, d, venue, dist, pool, rating, weight, t, CAST(hit AS INTEGER) AS y, (rating + 5) / 70.0::DOUBLE AS p,
  CASE WHEN d < DATE '1998-07-01' THEN 'STABLE' ELSE 'SHIFTED' END AS period FROM runs)
"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs(spark, sf_dir)
    period = F.when(F.col("d") < F.lit("1998-07-01").cast("date"), "STABLE").otherwise("SHIFTED")
    return out.select("grp", "member", "d", "venue", "dist", "pool", "rating", "weight", "t", F.col("hit").cast("int").alias("y"), ((F.col("rating") + 5) / F.lit(70.0)).alias("p"), period.alias("period"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits with the order of rows."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
