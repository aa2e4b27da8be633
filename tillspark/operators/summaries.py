"""A4, A8, A13 as maintained summaries: mergeable partials per ingested epoch.

A partial is a count and sums per key (day, customer, product), so partials add
up in any grouping and a deleted sale is a partial of sign -1.  Reports add the
compacted base, the partials since and the sales of the open day; none of them
reads the sales that are already summarised.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.sources.export import drop_folder, folder_entries


class Summary(NamedTuple):
    name: str
    key: str
    sums: tuple[str, ...]
    of_lines: bool = False

    @property
    def schema(self) -> str:
        kind = "date" if self.key == "date" else "long"
        return ", ".join([f"{self.key} {kind}", "rows long", *[f"{s} long" for s in self.sums]])


DAILY = Summary("daily", "date", ("total",))
CUSTOMERS = Summary("customers", "customer_id", ("total",))
PRODUCTS = Summary("products", "product_id", ("qty", "subtotal"), of_lines=True)
SUMMARIES = (DAILY, CUSTOMERS, PRODUCTS)


def partial(kind: Summary, rows: DataFrame, sign: int = 1) -> DataFrame:
    """(key, rows, sums) of some sales or lines; ``sign`` -1 takes them back."""
    keyed = rows.where(F.col(kind.key).isNotNull())
    counted = keyed.groupBy(kind.key).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(s).cast("long").alias(s) for s in kind.sums])
    return counted if sign == 1 else counted.select(kind.key, *[(-F.col(c)).alias(c) for c in ("rows", *kind.sums)])


def merged(kind: Summary, parts: list[DataFrame]) -> DataFrame:
    """The sum of partials; keys whose rows are all taken back are gone."""
    columns = [kind.key, "rows", *kind.sums]
    union = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    total = union.groupBy(kind.key).agg(*[F.sum(c).cast("long").alias(c) for c in columns[1:]])
    return total.where("rows <> 0")


class SummaryStore:
    """Partials under ``root/<name>/epoch=<n>``, compacted into ``root/<name>/base=<n>``.

    Writing an epoch twice replaces it; an epoch that is already compacted is
    refused, so a late replay cannot count twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _numbers(self, kind: Summary, prefix: str) -> list[int]:
        folder = f"{self.root}/{kind.name}"
        names = [n for n in folder_entries(self.spark, folder) if n.startswith(f"{prefix}=")]
        return sorted(int(n.split("=", 1)[1]) for n in names if "_SUCCESS" in folder_entries(self.spark, f"{folder}/{n}"))

    def _read(self, kind: Summary, folder: str) -> DataFrame:
        return self.spark.read.schema(kind.schema).parquet(f"{self.root}/{kind.name}/{folder}")

    def base(self, kind: Summary) -> int:
        return max(self._numbers(kind, "base"), default=-1)

    def add_epoch(self, epoch: int, headers: DataFrame, lines: DataFrame, sign: int = 1) -> None:
        for kind in SUMMARIES:
            if epoch <= self.base(kind):
                raise ValueError(f"epoch {epoch} of {kind.name} is already compacted")
            rows = partial(kind, lines if kind.of_lines else headers, sign)
            rows.write.mode("overwrite").parquet(f"{self.root}/{kind.name}/epoch={epoch}")

    def parts(self, kind: Summary) -> list[DataFrame]:
        base = self.base(kind)
        out = [self._read(kind, f"base={base}")] if base >= 0 else []
        return out + [self._read(kind, f"epoch={e}") for e in self._numbers(kind, "epoch") if e > base]

    def read(self, kind: Summary, open_rows: DataFrame | None = None) -> DataFrame:
        """The summary as of now; ``open_rows`` are sales or lines not yet in an epoch."""
        parts = self.parts(kind) + ([partial(kind, open_rows)] if open_rows is not None else [])
        return merged(kind, parts) if parts else self.spark.createDataFrame([], kind.schema)

    def compact(self) -> None:
        """Fold all epochs into a new base, then drop what it replaces."""
        for kind in SUMMARIES:
            epochs, old = self._numbers(kind, "epoch"), self.base(kind)
            fresh = [e for e in epochs if e > old]
            if fresh:
                merged(kind, self.parts(kind)).write.mode("overwrite").parquet(f"{self.root}/{kind.name}/base={fresh[-1]}")
            for e in epochs:
                drop_folder(self.spark, f"{self.root}/{kind.name}/epoch={e}")
            if fresh and old >= 0:
                drop_folder(self.spark, f"{self.root}/{kind.name}/base={old}")


def daily_revenue(summary: DataFrame, start, end) -> DataFrame:
    """A4 from the daily summary."""
    return summary.where(F.col("date").between(F.lit(start), F.lit(end))).select("date", "total")


def customer_totals(customers: DataFrame, summary: DataFrame) -> DataFrame:
    """A8 from the customer summary: 0, 0 for customers without sales."""
    s = summary.select(F.col("customer_id").alias("_cid"), "rows", "total")
    zero = F.lit(0).cast("long")
    j = customers.join(s, F.col("id") == F.col("_cid"), "left")
    return j.select("id", "name", F.coalesce("rows", zero).alias("total_transactions"), F.coalesce("total", zero).alias("total_spent"))
