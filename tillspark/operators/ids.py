"""Dense positions and keys over a total order, without a one-partition window.

``orderBy`` range-partitions and sorts; each row's position is the number
of rows in earlier partitions (a prefix sum over one count per partition,
a frame as small as the partition count) plus its index inside its own
partition (from ``monotonically_increasing_id``, whose low 33 bits count
rows within a partition).  The tagged frame is written to the shared
folder first, so the partition assignment is fixed once and both
uses read the same rows, also after a lost executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint to the shared ``spark.checkpoint.dir``:
    computes ``df`` once and cuts its lineage (survives lost executors).

    The checkpoint write reuses the shuffle outputs of the counting job, so
    only the last stage runs twice (measured: cheaper than writing and
    re-reading a Parquet table, which re-executes the whole plan).  The
    folder is read from the session.  Only a local-mode session without one
    (tests) gets a scratch folder; a cluster without the setting is an
    error, since a machine-local folder would not be shared.
    """
    _shared_folder(df)
    return df.checkpoint(eager=True)


def _shared_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        folder = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tillspark-ckpt-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def store_once(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Every step of the plan runs once (a checkpoint runs the last one twice: for
    the count and for the write), and readers take only the columns they use.
    The files are removed when the session's JVM ends.
    """
    path = f"{_shared_folder(df).rstrip('/')}/tillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def global_positions(df: DataFrame, order: list[Column], pos_col: str = "position") -> DataFrame:
    """Attach 1-based positions under ``order`` (which must be a total order)."""
    tagged = (
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = store_once(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(pos_col, F.col("_off") + local + 1)
        .drop("_pid", "_mid", "_off")
    )


def assign_ids(df: DataFrame, order: list[Column], start_after: Column | int, id_col: str = "id") -> DataFrame:
    """``id = start_after + position`` for new rows, dense and ordered.

    ``start_after`` is usually ``current.agg(max(id)).scalar()``: a scalar
    subquery evaluated once, not a join.
    """
    pos = global_positions(df, order, "_pos")
    base = F.lit(start_after) if isinstance(start_after, int) else start_after
    return pos.withColumn(id_col, (base + F.col("_pos")).cast("long")).drop("_pos")
