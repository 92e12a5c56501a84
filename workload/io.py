"""Sources, sinks and the catalog, as round trips of whole tables through the scratch folder."""

from pyspark.sql import functions as F

from quillframe.session import scratch_path
from quillframe.sources import catalog, readers, writers
from workload.base import SQL_GAPS, SQL_ORDERS, day, gaps, plain_orders, query

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"


@query(CUSTOMER_SQL)
def read_csv(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.customer, path)
    return readers.read_csv(t.spark, path)


@query(f"select l_orderkey, l_linenumber, l_partkey, l_tax, l_returnflag, l_shipdate from {SQL_GAPS}")
def read_csv_schema(t):
    """Null tokens come back as nulls under a declared schema."""
    path = scratch_path(t.spark, "csv")
    rows = gaps(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", F.coalesce("l_returnflag", F.lit("N/A")).alias("l_returnflag"), "l_shipdate")
    writers.write_csv(rows, path)
    return readers.read_csv(
        t.spark, path, schema="l_orderkey bigint, l_linenumber int, l_partkey bigint, l_tax double, l_returnflag string, l_shipdate string")


@query(CUSTOMER_SQL.replace("cast(c_nationkey as bigint) as c_nationkey", "c_nationkey"))
def write_csv(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.customer, path, ["c_custkey", "c_name", "absent", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return t.spark.read.schema(CUSTOMER).csv(path, header=True, escape='"')


@query(CUSTOMER_SQL)
def read_json(t):
    """JSON Lines back into rows, without being told that they are lines."""
    path = scratch_path(t.spark, "json")
    writers.write_json(t.customer, path)
    return readers.read_json(t.spark, path)


ITEMS = 50_000  # line items in a document


def documents(df, label):
    """Rows of text as files of one document each, written by all tasks."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


def items(t, by, *columns):
    """(by, items): the line items of each supplier or order as a list; no list grows with the table."""
    return t.lineitem.groupBy(by).agg(F.collect_list(F.struct(*columns)).alias("items"))


def batches(t, *columns):
    """(items): all line items in lists of ``ITEMS`` neighbours; few files hold them, however many suppliers there are."""
    rows = t.lineitem.select(F.struct(*columns).alias("item"), F.expr(f"monotonically_increasing_id() div {ITEMS}").alias("batch"))
    return rows.groupBy("batch").agg(F.collect_list("item").alias("items"))


LISTED = ["l_orderkey", "l_linenumber", "l_quantity"]
LISTED_SQL = "select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem"


@query(LISTED_SQL)
def read_json_list(t):
    """A file per batch of line items, each a list."""
    return readers.read_json(t.spark, documents(batches(t, *LISTED).select(F.to_json("items").alias("value")), "list"))


@query(LISTED_SQL)
def read_json_first_list(t):
    """A file per batch of line items, over several lines, whose first list by position is not the first by name."""
    text = F.concat(F.lit('{"z": 1,\n "rows":\n'), F.to_json("items"), F.lit(',\n "a": [{"l_quantity": 0.5}]}'))
    return readers.read_json(t.spark, documents(batches(t, *LISTED).select(text.alias("value")), "object"))


@query(LISTED_SQL)
def read_json_records(t):
    """A line per order, each with its items under a named key."""
    path = scratch_path(t.spark, "json")
    items(t, "l_orderkey", *LISTED).select(F.to_json(F.struct("l_orderkey", F.col("items").alias("lines"))).alias("value")).write.text(path)
    return readers.read_json(t.spark, path, records_path="lines")


@query(LISTED_SQL)
def read_api_dump(t):
    """Landed responses, a line per order, with the rows at ``data.items``."""
    path = scratch_path(t.spark, "api")
    body = F.struct(F.lit("ok").alias("status"), F.struct("items").alias("data"))
    items(t, "l_orderkey", *LISTED).select(F.to_json(body).alias("value")).write.text(path)
    return readers.read_api_dump(t.spark, path, "$.data.items")


@query("select l_suppkey, count(*) as items, 'ok' as status from lineitem group by l_suppkey")
def read_api_dump_whole(t):
    """A response per supplier, each on a line and kept as one row."""
    path = scratch_path(t.spark, "api")
    body = F.to_json(F.struct(F.lit("ok").alias("status"), "l_suppkey", "items"))
    items(t, "l_suppkey", "l_orderkey").select(body.alias("value")).write.text(path)
    dump = readers.read_api_dump(t.spark, path)
    return dump.select("l_suppkey", F.size("items").cast("bigint").alias("items"), "status")


BROKEN_LINES = "doc_id || ',\"quoted\"' || chr(10) || text || chr(10)"


@query(f"select doc_id, {BROKEN_LINES} as text, lang from documents")
def read_csv_line_breaks(t):
    """Quoted fields with line breaks, quotes and commas."""
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.documents.selectExpr("doc_id", f"{BROKEN_LINES} as text", "lang"), path)
    return readers.read_csv(t.spark, path, schema="doc_id bigint, text string, lang string")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def write_json(t):
    path = scratch_path(t.spark, "json")
    writers.write_json(t.customer, path)
    return t.spark.read.schema(CUSTOMER).json(path)


@query(f"select * from {SQL_ORDERS}")
def read_parquet(t):
    return readers.read_parquet(t.spark, t.path("orders")).withColumn("o_orderdate", day("o_orderdate"))


@query(f"select o_orderkey, o_totalprice, o_orderstatus from {SQL_ORDERS}")
def write_parquet(t):
    path = scratch_path(t.spark, "parquet")
    writers.write_parquet(plain_orders(t), path, ["o_orderkey", "o_totalprice", "o_orderstatus"], partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path)


@query(f"select *, (select count(*) from orders) as row_count, 6 as col_count from {SQL_ORDERS} x order by x.o_orderkey limit 20")
def preview(t):
    return readers.preview(plain_orders(t), 20, ["o_orderkey"])


def _listed_sql(name: str, columns: list[str]) -> str:
    rows = f"(select count(*) from (select distinct * from {name}))"
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    score = (f"round_even((1 - sum({nulls}) / (count(*) * {len(columns)})) * 40 + (1 - (count(*) - any_value(d)) / count(*)) * 30 + 30, 2)")
    score = score.replace(f"sum({nulls})", f"({nulls})")
    return f"""select '{name}' as dataset_id, '{name}' as name, 'parquet' as source_type, count(*) as row_count, {len(columns)} as col_count,
  2::bigint as size_bytes, {score} as quality_score, '{",".join(columns)}' as columns from {name}, (select {rows} as d)"""


LISTED_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


@query("\nunion all\n".join(_listed_sql(n, c) for n, c in LISTED_COLUMNS.items()))
def catalog_list(t):
    """Two records per table; the later one is listed."""
    out = None
    for name in LISTED_COLUMNS:
        for version in (1, 2):
            record = catalog.catalog_record(getattr(t, name), name, size_bytes=version)
            record = record.withColumn("created_at", F.expr(f"timestamp '2024-01-0{version} 00:00:00'"))
            out = record if out is None else out.unionByName(record)
    listed = catalog.catalog_list(out).withColumn("columns", F.array_join(F.transform("columns", lambda c: c["name"]), ","))
    return listed.select("dataset_id", "name", "source_type", "row_count", "col_count", "size_bytes", "quality_score", "columns")
