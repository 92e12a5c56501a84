"""Registry, table access and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import SESSION_SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The Parquet tables of one scale folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL that must give the same rows."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", SESSION_SETTINGS["spark.sql.session.timeZone"])
            return fn(Tables(spark, folder))

        key = name or fn.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def all_rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def instant(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def sql_instant(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_p_value(r: str, n: str) -> str:
    """The two-sided p-value of a correlation ``r`` of ``n`` pairs: Simpson's rule over Student's density."""
    free = f"({n} - 2)"
    t = f"least(abs({r}) * sqrt({free} / greatest(1 - {r} * {r}, 1e-12)), 40)"
    scale = f"exp(lgamma(({free} + 1) / 2.0) - lgamma({free} / 2.0)) / sqrt(pi() * {free})"
    weight = "case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end"
    density = f"pow(1 + pow(i * {t} / 4000, 2) / {free}, -({free} + 1) / 2.0)"
    return f"greatest(1 - 2 * {scale} * {t} / 12000 * list_sum(list_transform(range(0, 4001), lambda i: {weight} * {density})), 0)"


def union_all(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def expressions(columns: Iterable[str]) -> str:
    return ", ".join(columns)


# Derived tables, written so that Spark and the checking engine read the same expressions.
GAP_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "nullif(l_discount, cast(0 as double)) as l_discount", "case when l_quantity > 45 then l_tax end as l_tax",
    "nullif(l_returnflag, 'N') as l_returnflag", "l_linestatus", "cast(cast(l_shipdate as date) as string) as l_shipdate",
)
ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "cast(cast(o_orderdate as date) as string) as o_orderdate",
    "o_orderpriority",
)
SQL_GAPS = f"(select {expressions(GAP_COLUMNS)} from lineitem)"
SQL_ORDERS = f"(select {expressions(ORDER_COLUMNS)} from orders)"
SQL_DAILY = "(select o_orderdate as t, sum(o_totalprice) as v from orders group by o_orderdate)"
LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def gaps(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*GAP_COLUMNS)


def plain_orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*ORDER_COLUMNS)


def daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("v"))
