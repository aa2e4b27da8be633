"""M4 / M8: staff records upsert with password and username rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions.text import ci_key
from tillspark.operators.mutations import apply_updates, insert_rows, is_new_key, reject_existing
from tillspark.operators.quality import validate_users
from tillspark.sources.changes import password_digest

USER_UPDATE_COLS = ["name", "username", "password_digest", "role", "status"]
E_TAKEN = "username taken"


def _first_of_username(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of each case-insensitive username in column order, the others)."""
    order = Window.partitionBy(ci_key("username")).orderBy("id", "username", *[c for c in USER_UPDATE_COLS if c != "username"])
    ranked = batch.withColumn("_rn", F.row_number().over(order))
    return ranked.where("_rn = 1").drop("_rn"), ranked.where("_rn > 1").drop("_rn")


def upsert_users(users: DataFrame, changes: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Apply staff form rows (id, name, username, role, status, password).

    Updates: an empty password keeps the stored digest.  Inserts need a password.
    A username (case-insensitive) belongs to one record: a row is rejected that
    takes one stored under another id, or that an earlier row of the batch takes;
    new rows also give way to the usernames that updates take.
    Returns (new snapshot, rejected change rows with ``errors``).
    """
    checked = validate_users(changes).withColumn("password_digest", password_digest("password"))
    updates = checked.where(~is_new_key("id") & F.col("accepted"))
    stored = users.select(F.col("id").alias("_id"), ci_key("username").alias("_key"))
    of_another = (ci_key("username") == F.col("_key")) & (F.col("id") != F.col("_id"))
    renamed_onto = updates.join(stored, of_another, "left_semi")
    updates, repeated_updates = _first_of_username(updates.join(stored, of_another, "left_anti"))
    inserts, repeated = _first_of_username(checked.where(is_new_key("id") & F.col("accepted")))
    names = users.select("username").union(updates.select("username"))
    fresh, taken = reject_existing(inserts, names, F.col("username"), F.col("username"))
    updated = apply_updates(users, updates, "id", USER_UPDATE_COLS, only_if_present=("password_digest",))
    new_rows = insert_rows(
        users,
        fresh.select("name", "username", "password_digest", "role", "status"),
        "id",
        [F.col("username")],
        {"created_at": as_of},
    )
    clashes = taken.unionByName(repeated).unionByName(repeated_updates).unionByName(renamed_onto)
    rejected = checked.where(~F.col("accepted")).unionByName(
        clashes.withColumn("errors", F.lit(E_TAKEN)).withColumn("accepted", F.lit(False))
    )
    return updated.unionByName(new_rows), rejected.drop("password", "password_digest")
