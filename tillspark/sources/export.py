"""S5-S8 sinks: CSV and JSON documents, written in parallel part files.

CSV follows PHP ``fputcsv`` quoting: a quote inside a field is doubled
(``escape='"'``), and an empty string is written as an empty field like NULL.
Output is parse-equal to the reference, not byte-equal (quoting of fields
with blanks may differ).  ``single_file`` coalesces to one part only on
request: it funnels every row through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(
    df: DataFrame,
    path: str,
    header: list[str] | None = None,
    order: list | None = None,
    single_file: bool = False,
    mode: str = "overwrite",
) -> None:
    out = df.orderBy(*order) if order else df
    if header is not None:
        if len(header) != len(out.columns):
            raise ValueError("header length differs from the column count")
        out = out.toDF(*header)
    if single_file:
        out = out.coalesce(1)
    (
        out.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_csv_ordered(df: DataFrame, path: str, order: list[tuple[str, bool]], header: list[str] | None = None, mode: str = "overwrite") -> None:
    """S5-S7 in order: part files that, concatenated by name, are one CSV in
    ``order`` with a single header line.

    ``orderBy`` deals the rows out by ranges of the order and sorts each range in
    its own task, so nothing passes through one task; the header line is a row
    that sorts before all others and so opens the first part.  ``order`` holds
    (column, descending) pairs; columns whose names begin with an underscore
    are sorted by but not written.
    """
    shown = [c for c in df.columns if not c.startswith("_")]
    names = header or shown
    if len(names) != len(shown):
        raise ValueError("header length differs from the column count")
    rows = df.select(F.lit(1).alias("__line"), *[F.col(f"`{c}`") for c in df.columns])
    keys = [f"__k{i}" for i in range(len(order))]
    rows = rows.select("__line", *[F.col(f"`{c}`").cast("string").alias(c) for c in shown], *[F.col(c).alias(k) for (c, _), k in zip(order, keys)])
    first = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).alias("__line"), *[F.lit(n).alias(c) for n, c in zip(names, shown)], *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
    )
    sorted_rows = first.unionByName(rows).orderBy("__line", *[F.col(k).desc() if desc else F.col(k) for (_, desc), k in zip(order, keys)])
    writer = sorted_rows.select(*[F.col(f"`{c}`") for c in shown]).write.mode(mode)
    writer.option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """Read a CSV written by ``write_csv`` back with a declared schema."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )


def to_document(df: DataFrame, keep: list[str] | None = None, col: str = "document") -> DataFrame:
    """Each row as a JSON object (NULL fields kept as ``null``)."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*(keep or []), body.alias(col))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines part files, one object per row."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


MONTH_COL = "month"


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add the ``month`` partition column (first day of the sale's month)."""
    return df.withColumn(MONTH_COL, F.trunc(F.col(date_col), "month"))


def write_snapshot(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write a complete new table version under ``root/version=<version>``.

    Mutations (upserts, deletes, ingest) produce whole new snapshots; readers
    switch to a version only once it is fully written (``_SUCCESS``), so a
    failed job never exposes a half-written table and re-running it rewrites
    the same version folder.  ``partition_by`` (e.g. ``["month"]`` for the
    sale tables) lets period filters prune whole folders.
    """
    path = f"{root.rstrip('/')}/version={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def folder_entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system; none if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def latest_version(spark: SparkSession, root: str) -> str | None:
    """The newest fully written version folder under ``root``: numbers by value,
    after versions that are not numbers (by code point)."""
    root = root.rstrip("/")
    done = [
        d for d in folder_entries(spark, root) if d.startswith("version=") and "_SUCCESS" in folder_entries(spark, f"{root}/{d}")
    ]

    def age(folder: str) -> tuple[int, str]:
        version = folder.split("=", 1)[1]
        return (int(version) if version.isascii() and version.isdigit() else -1, version)

    return f"{root}/{max(done, key=age)}" if done else None


def read_snapshot(spark, root: str, schema=None) -> DataFrame:
    path = latest_version(spark, root)
    if path is None:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
