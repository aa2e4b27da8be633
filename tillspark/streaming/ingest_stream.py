"""Streaming form of sale ingestion.

``readStream`` of JSON sale documents -> stateful dedup by invoice number ->
``foreachBatch`` running the batch ingest -> accepted headers and lines appended
per epoch.  An epoch's work does not grow with the epochs before it:

* invoice numbers seen are Spark's own state (JVM, in the query checkpoint): the
  first document of a number that arrives is judged, later ones are dropped,
  whatever became of the first;
* stock and the last id are a snapshot that each epoch rewrites from the one
  before.  Only the newest two are kept.

Each epoch writes to its own ``epoch=<id>`` folders in overwrite mode and reads
the newest complete snapshot of an earlier epoch, so a micro-batch replayed after
a failure replaces its own output and takes stock once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.functions.text import ci_key
from tillspark.operators.ids import materialize
from tillspark.plans import ingest
from tillspark.schemas import SALE_DOCUMENT
from tillspark.sources.export import drop_folder, folder_entries

KEPT_SNAPSHOTS = 2


def _epochs(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in folder_entries(spark, path) if n.startswith("epoch="))


class SalesIngestSink:
    """``foreachBatch`` target: store-aware ingest with per-epoch outputs.

    ``deduplicated``: the batches come from ``start_sales_ingest``, whose state
    has dropped the invoices seen before.  A sink fed otherwise compares with the
    invoice numbers of all earlier epochs.
    """

    def __init__(self, store: DataFrame, products: DataFrame, headers_path: str, lines_path: str, state_path: str | None = None):
        self.store = store.select("id", "invoice_no")
        self.products = products
        self.headers_path = headers_path.rstrip("/")
        self.lines_path = lines_path.rstrip("/")
        self.state_path = (state_path or f"{self.headers_path}-state").rstrip("/")
        self.deduplicated = False

    def _snapshots(self, spark: SparkSession, before: int) -> list[int]:
        """Epochs with a complete snapshot (the id folder is written last)."""
        return [
            e
            for e in _epochs(spark, self.state_path)
            if e < before and "_SUCCESS" in folder_entries(spark, f"{self.state_path}/epoch={e}/last_id")
        ]

    def state(self, spark: SparkSession, epoch_id: int) -> tuple[DataFrame, int | None]:
        """Products as left by the epochs before ``epoch_id``, and the last id
        given out (None: that of the store)."""
        done = self._snapshots(spark, epoch_id)
        if not done:
            return self.products, None
        root = f"{self.state_path}/epoch={done[-1]}"
        stock = spark.read.schema(self.products.schema).parquet(f"{root}/products")
        return stock, spark.read.schema("id long").parquet(f"{root}/last_id").first().id

    def _stored(self, spark: SparkSession, epoch_id: int) -> DataFrame:
        if self.deduplicated or not any(e < epoch_id for e in _epochs(spark, self.headers_path)):
            return self.store
        heads = spark.read.parquet(self.headers_path).where(F.col("epoch") < epoch_id)
        return self.store.unionByName(heads.select(F.col("id").cast("long"), "invoice_no"))

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        products, last_id = self.state(spark, epoch_id)
        # a stateful batch must be read once: what the state let through is fixed here
        headers, lines = ingest.split_documents(materialize(batch.select(*SALE_DOCUMENT.fieldNames())))
        done = ingest.ingest(headers, lines, self._stored(spark, epoch_id), products, last_id)
        folder = f"epoch={epoch_id}"
        done.headers.write.mode("overwrite").parquet(f"{self.headers_path}/{folder}")
        done.lines.write.mode("overwrite").parquet(f"{self.lines_path}/{folder}")
        taken = done.stock.select(F.col("id").alias("_tid"), F.col("stock").alias("_left"))
        left = products.join(taken, F.col("id") == F.col("_tid"), "left").withColumn("stock", F.coalesce("_left", "stock"))
        left.select(*products.columns).write.mode("overwrite").parquet(f"{self.state_path}/{folder}/products")
        highest = spark.read.schema("id long").parquet(f"{self.headers_path}/{folder}").agg(F.max("id").alias("id"))
        before = F.lit(last_id).cast("long") if last_id is not None else self.store.agg(F.max("id").cast("long")).scalar()
        highest.select(F.coalesce("id", before, F.lit(0).cast("long")).alias("id")).write.mode("overwrite").parquet(
            f"{self.state_path}/{folder}/last_id"
        )
        for old in self._snapshots(spark, epoch_id + 1)[:-KEPT_SNAPSHOTS]:
            drop_folder(spark, f"{self.state_path}/epoch={old}")


def unseen_invoices(docs: DataFrame) -> DataFrame:
    """The first document of each invoice number (stateful on a stream).
    Documents without a number pass once per distinct body."""
    body = F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns])), 256)
    keyed = docs.withColumn("_seen", F.coalesce(F.concat(F.lit("#"), ci_key("invoice_no")), body))
    return keyed.dropDuplicates(["_seen"]).drop("_seen")


def start_sales_ingest(
    spark: SparkSession,
    source_dir: str,
    sink: SalesIngestSink,
    checkpoint_location: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the streaming ingest; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(SALE_DOCUMENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = unseen_invoices(reader.json(source_dir))
    sink.deduplicated = True
    writer = docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
