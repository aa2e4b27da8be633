"""Declared-schema scans of the driver's parquet tables.

Schemas are declared (never inferred) and every read is followed by an
explicit projection, so ``ReadSchema`` carries only the columns in use and
filters on them reach the Parquet reader as ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S, Dbl, TS = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _schema(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


RAW_SCHEMAS = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", Dbl)),
    "customer": _schema(
        ("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", Dbl), ("c_mktsegment", S)
    ),
    "part": _schema(
        ("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I), ("p_retailprice", Dbl)
    ),
    "orders": _schema(
        ("o_orderkey", L),
        ("o_custkey", L),
        ("o_orderstatus", S),
        ("o_totalprice", Dbl),
        ("o_orderdate", TS),
        ("o_orderpriority", S),
    ),
    "lineitem": _schema(
        ("l_orderkey", L),
        ("l_partkey", L),
        ("l_suppkey", L),
        ("l_linenumber", I),
        ("l_quantity", Dbl),
        ("l_extendedprice", Dbl),
        ("l_discount", Dbl),
        ("l_tax", Dbl),
        ("l_returnflag", S),
        ("l_linestatus", S),
        ("l_shipdate", TS),
    ),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one table with its declared schema, keeping only ``columns``."""
    reader = spark.read
    if name in RAW_SCHEMAS:
        reader = reader.schema(RAW_SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scan(df: DataFrame) -> DataFrame:
    """S1 ``SELECT *`` over an already-mapped table: identity, kept lazy."""
    return df.select("*")


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small literal table built JVM-side (``inline`` of a constant array).

    ``spark.createDataFrame(list)`` would ship the rows through a Python RDD
    and start a Python worker for every scan; this stays in codegen.
    """
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def read_model(spark: SparkSession, root: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Read the model tables stored as Parquet under ``root/<table>`` with
    their declared schemas (``tillspark.schemas``).

    Fact tables written month-partitioned (``sources.export.with_month`` +
    ``write_snapshot(..., partition_by=["month"])``) keep their ``month``
    column, which ``period_filter`` uses for partition pruning; a folder of
    versions is resolved to its newest complete version.
    """
    from tillspark import schemas
    from tillspark.sources.export import MONTH_COL, latest_version

    out: dict[str, DataFrame] = {}
    for name in tables or list(schemas.TABLES):
        path = f"{root.rstrip('/')}/{name}"
        path = latest_version(spark, path) or path
        df = spark.read.parquet(path)
        declared = schemas.TABLES[name]
        cols = [F.col(f.name).cast(f.dataType) for f in declared.fields]
        if MONTH_COL in df.columns:
            cols.append(F.col(MONTH_COL))
        out[name] = df.select(*cols)
    return out
