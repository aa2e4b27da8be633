"""Shared helpers: scratch tables in the shared folder, column hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillspark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local-mode session without one (tests)
    gets a scratch folder, a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tillspark-llm-"))


def scratch_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stores compressed columns.  The
    files are removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(table: DataFrame) -> None:
    """Remove the files of a scratch table that no later step reads."""
    if files := table.inputFiles():
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (any letter case)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def with_position(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, read straight from Parquet files, with a dense row number.

    The number of rows in earlier files (by path) plus the index in the file:
    it does not depend on how the scan is split into tasks.  The broadcast holds
    one row per input file, as bounded as the driver's own file listing.
    """
    meta = rows.metadataColumn("_metadata")
    placed = rows.withColumns({"__file": meta["file_path"], "__row": meta["row_index"]})
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    offsets = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__before") + F.col("__row"))
    return numbered.drop("__file", "__row", "__before")
