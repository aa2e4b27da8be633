"""Nested sale documents (JSON) in and out.

A posted sale is one JSON object: header fields plus an ``items`` array.
Files are read with the declared schema (no inference); a string column
holding such bodies is parsed with ``from_json``.  Bodies that are no sale
document are kept apart with the reason (``problem``), never dropped silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.schemas import SALE_DOCUMENT

HEADER_FIELDS = [f.name for f in SALE_DOCUMENT.fields if f.name != "items"]


def read_sales_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files of sale documents, one object per line."""
    return spark.read.schema(SALE_DOCUMENT).option("mode", "PERMISSIVE").json(path)


def parse_sale_documents(df: DataFrame, body_col: str = "body") -> DataFrame:
    """parse a column of JSON bodies into document columns (malformed -> NULLs)."""
    return df.select(F.from_json(F.col(body_col), SALE_DOCUMENT).alias("_doc")).select("_doc.*")


# Reasons why a body is no sale document (wording of this library).
EMPTY = "empty"
MALFORMED = "malformed"
_CORRUPT = "_corrupt"


def parse_posted(df: DataFrame, body_col: str = "body") -> DataFrame:
    """The other columns of ``df``, the document columns and ``problem``.

    ``problem`` is null for a sale document; ``empty`` for a null or blank body or
    an object without any known field; ``malformed`` for text that is no JSON
    object or holds a value of another type than declared.  Only sale documents
    have document columns.  The whole schema is parsed whatever is read of it, so
    the verdict on a body does not depend on the columns in use.
    """
    schema = T.StructType([*SALE_DOCUMENT.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    keep = [F.col(f"`{c}`") for c in df.columns if c != body_col and c not in SALE_DOCUMENT.fieldNames() and c != "problem"]
    fields = [F.col(f"_doc.{c}") for c in SALE_DOCUMENT.fieldNames()]
    blank = F.coalesce(F.col(body_col).rlike(r"^\s*$"), F.lit(True))
    nothing = reduce(lambda a, b: a & b, [f.isNull() for f in fields])
    corrupt = F.col("_doc").isNull() | F.col(f"_doc.{_CORRUPT}").isNotNull()
    problem = F.when(blank, EMPTY).when(corrupt, MALFORMED).when(nothing, EMPTY)
    parsed = df.withColumn("_doc", F.from_json(F.col(body_col), schema, options)).withColumn("problem", problem)
    return parsed.select(*keep, *[F.when(F.col("problem").isNull(), f).alias(n) for n, f in zip(SALE_DOCUMENT.fieldNames(), fields)], "problem")


def posted_lines(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Lines of the sale documents among posted bodies: (invoice_no, product_id,
    name, qty, price, subtotal).  Bodies are made distinct before they are parsed, so
    a re-post of the same text counts once and is parsed once."""
    documents = parse_posted(df.select(body_col).distinct(), body_col).where("problem IS NULL")
    return documents.select("invoice_no", F.explode("items").alias("_line")).select("invoice_no", "_line.*")


def to_json_documents(docs: DataFrame, body_col: str = "body") -> DataFrame:
    """one JSON body per document."""
    return docs.select(F.to_json(F.struct(*[F.col(c) for c in SALE_DOCUMENT.fieldNames()])).alias(body_col))
