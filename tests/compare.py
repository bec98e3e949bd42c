"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


DUCK_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


SCHEMAS = {}


def compare(spark, name, build, sql, folder):
    """None when equal, else a text that says what differs."""
    df = build(spark, folder)
    SCHEMAS[name] = df.schema.simpleString()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = duck(folder).sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} / {sorted(relation.columns)}"
    types = spark_types(df)
    for column, kind in zip(relation.columns, relation.types):
        if DUCK_NAMES.get(str(kind), str(kind)) != types[column]:
            return f"type of {column}: {types[column]} / {kind}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    different = [(a, b) for a, b in zip(got, want) if a != b]
    if different:
        return f"{len(different)} of {len(want)} rows differ, first: {different[:2]}"
    return None


def main() -> None:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.enabled", os.environ.get("COALESCE", "true"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problem = compare(spark, name, build, oracles[name], folder) if name in oracles else (
                f"no SQL, {build(spark, folder).count()} rows"
            )
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - began:6.2f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
