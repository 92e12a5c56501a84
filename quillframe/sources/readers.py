"""Reading CSV, JSON, Parquet, JDBC tables and landed API responses."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.columns import string_columns
from quillframe.operators import blocks
from quillframe.operators.text import FORBIDDEN_SQL
from quillframe.sources import csv_records

# Texts read as null, truth values, databases a query may be sent to.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
JDBC_SCHEMES = ("postgresql", "mysql", "sqlite", "sqlserver")

SPLIT_ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")  # whose lines Spark can tell apart and decode


def _names(header: str, sep: str, quote: str) -> list[str]:
    """The columns of a header, named as Spark does: empty names by place, repeated ones with their place."""
    names = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep, quotechar=quote))
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _csv_rows(spark: SparkSession, path, encoding: str | None, options: dict) -> DataFrame:
    """All fields as strings. Files with the same header are read together; the columns of others are matched by name."""
    sep, quote = options.get("sep", options.get("delimiter", ",")), options.get("quote", '"')
    rows, files = csv_records.records(spark, path, sep, quote, encoding)
    first = files.filter("header IS NOT NULL").groupBy("header").agg(F.min("file").alias("file"))
    headers = [r["header"] for r in first.orderBy("file").collect()]  # one per layout
    parts = []
    for header in headers:
        part = rows if len(headers) == 1 else rows.join(files.filter(F.col("header") == header).select("file"), "file")
        names = _names(header, sep, quote)
        fields = ", ".join(f"`f{i}` string" for i in range(len(names)))
        parsed = F.from_csv("text", F.lit(fields), {**options, "escape": '"', "mode": "PERMISSIVE"})
        parts.append(part.select(parsed.alias("r")).select(*[F.col(f"r.f{i}").alias(n) for i, n in enumerate(names)]))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None, encoding: str | None = None,
    lines: bool = False, **options,
) -> DataFrame:
    """CSV with a header. Files that are not UTF-8 are read as Latin-1; null tokens become null.

    Quoted fields may hold line breaks, and large files are read by many tasks all the same: see ``csv_records``. ``lines`` says that
    no field holds one (and all files are UTF-8 or in ``encoding``), which spares a pass. Without a ``schema`` columns become
    bigint, double or boolean if all their values fit. A named encoding other than those of ``SPLIT_ENCODINGS`` makes a file one task.
    """
    if lines or (encoding or "UTF-8").upper() not in SPLIT_ENCODINGS:
        reader = spark.read.options(header=True, encoding=encoding or "UTF-8", mode="PERMISSIVE", escape='"', multiLine=not lines, **options)
        out = reader.csv(path if isinstance(path, str) else list(path))
    else:
        out = _csv_rows(spark, path if isinstance(path, str) else list(path), encoding, options)
    out = out.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in out.columns])
    if schema is None:
        return infer_types(out)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return out.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to bigint, double or boolean where every value fits (one pass)."""
    names = string_columns(df)
    tests = {}
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        tests[f"n{i}"] = F.count(col)
        tests[f"l{i}"] = F.count_if(col.rlike(r"^\s*[+-]?\d+\s*$") & col.try_cast("bigint").isNotNull())
        tests[f"d{i}"] = F.count_if(col.rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"))
        tests[f"b{i}"] = F.count_if(col.isin(*TRUE_TOKENS, *FALSE_TOKENS))
    row = blocks.stats_row(df, tests)
    typed: dict[str, Column] = {}
    for i, c in enumerate(names):
        n, col = row[f"n{i}"], F.col(f"`{c}`")
        if n and row[f"b{i}"] == n:
            typed[c] = col.isin(*TRUE_TOKENS)
        elif n and row[f"l{i}"] == n:
            typed[c] = F.trim(col).cast("bigint")
        elif n and row[f"d{i}"] == n:
            typed[c] = F.trim(col).cast("double")
    return df.withColumns(typed) if typed else df


def _key_path(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


def _first_list_key(spark: SparkSession, path) -> str | None:
    """The first key, in document order, whose value is a list (one key is collected)."""
    raw = spark.read.text(path, wholetext=True).filter(F.trim("value").startswith("{"))
    fields = F.expr("variant_get(try_parse_json(value), '$', 'map<string,variant>')")
    found = raw.select(F.json_object_keys("value").alias("keys"), F.explode(fields).alias("key", "v"))
    lists = found.filter(F.expr("try_variant_get(v, '$', 'array<variant>')").isNotNull())
    first = lists.orderBy(F.array_position("keys", F.col("key"))).select("key").first()
    return first["key"] if first else None


def _one_per_line(spark: SparkSession, path) -> bool:
    """Whether the files hold a JSON document per line; if not, each must hold one document in all."""
    valid = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull()  # in brackets nothing may follow a document
    rows = spark.read.text(path).filter(F.trim("value") != "")
    by_file = rows.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_if(~valid).alias("broken"))
    found = by_file.agg(F.max("n").alias("n"), F.sum("broken").alias("broken")).first()
    if not found["broken"]:
        return (found["n"] or 0) > 1
    if spark.read.text(path, wholetext=True).filter(~valid).limit(1).count():
        raise ValueError("a file holds neither one JSON document nor one on each line")
    return False


def _document_schema(spark: SparkSession, path) -> T.StructType | None:
    """The columns of files of one document each; None where a file is not plain UTF-8 JSON.

    Spark's own inference opens such files one by one to plan its tasks. Read as text they share tasks; no separator that JSON may hold
    cuts them.
    """
    found = spark.read.json(path, lineSep="\0").schema
    return None if spark.conf.get("spark.sql.columnNameOfCorruptRecord") in found.names else found


def _documents(spark: SparkSession, path, schema, lines: bool | None) -> tuple[DataFrame, bool]:
    lines = _one_per_line(spark, path) if lines is None else lines
    if schema is None and not lines:
        schema = _document_schema(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines), lines


def _items(df: DataFrame, target: str) -> DataFrame:
    items = df.select(F.explode(F.col(target)).alias("item"))
    if isinstance(items.schema["item"].dataType, T.StructType):
        return items.select("item.*")
    return items.withColumnRenamed("item", "value")


def read_json(
    spark: SparkSession, path: str | Sequence[str], records_path: str | None = None, schema=None, lines: bool | None = None
) -> DataFrame:
    """JSON documents as rows: a top-level list, else the first list-valued key, else one row.

    Files with a document on every line (JSON Lines) give a row per line. ``lines`` says which form the files have;
    if it is not given they are read once more to find out, and anything else than one document
    per file or per line raises. ``records_path`` names the list directly (dots for nesting).
    """
    df, by_line = _documents(spark, path, schema, lines)
    if records_path is not None:
        return _items(df, ".".join(_key_path(k) for k in records_path.split(".")))
    key = None if by_line else _first_list_key(spark, path)
    return df if key is None else _items(df, _key_path(key))


def read_api_dump(spark: SparkSession, path: str | Sequence[str], json_path: str | None = None, schema=None, lines: bool | None = None) -> DataFrame:
    """Landed JSON responses, one per file or per line: list → rows, else one row per response; ``json_path`` names a list inside."""
    if json_path:
        return read_json(spark, path, json_path.removeprefix("$.").removeprefix("$"), schema, lines)
    return _documents(spark, path, schema, lines)[0]


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def jdbc_options(url: str, query: str) -> dict[str, str]:
    """Options for one checked SELECT; other statements and schemes are refused."""
    scheme = url.removeprefix("jdbc:").split(":", 1)[0].lower()
    if scheme not in JDBC_SCHEMES:
        raise ValueError(f"database scheme {scheme!r} not allowed; use one of {JDBC_SCHEMES}")
    if re.search(FORBIDDEN_SQL, query, re.IGNORECASE):
        raise ValueError("the query contains disallowed statements")
    if len(query) > 5000:
        raise ValueError("the query exceeds 5000 characters")
    return {"url": url, "query": query}


def read_sql(
    spark: SparkSession, url: str, query: str, partition_column: str | None = None,
    bounds: tuple | None = None, partitions: int | None = None, **options,
) -> DataFrame:
    """A SELECT in an external database; with a partition column it is read in parallel ranges."""
    chosen = jdbc_options(url, query)
    if partition_column:
        chosen["dbtable"] = f"({chosen.pop('query')}) q"
        chosen |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                   "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**chosen, **options).load()


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, with the table's row and column counts."""
    counts = df.agg(F.count("*").alias("row_count")).withColumn("col_count", F.lit(len(df.columns)))
    first = df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
    return first.crossJoin(F.broadcast(counts))  # one row
