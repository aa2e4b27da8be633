"""M5-M7 over the declared foreign keys: one delete request, all tables consistent.

A request names keys of any tables.  CASCADE adds the rows that go with them, at
any depth; RESTRICT refuses a row to which a surviving row points, and with it the
requested rows whose cascade would have removed it; SET NULL clears the pointers
of survivors.  A refusal lets rows survive that may refuse others, so refusals
are repeated until none is new: the result is the largest part of the request
that leaves no dangling key, whatever the order of its rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.operators.ids import materialize
from tillspark.operators.mutations import DECISION_DELETED, DECISION_PROTECTED, DECISION_REFERENCED, on_delete_set_null

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"
DECISION_MISSING = "no such row"


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    action: str


#: the store's declared keys
FOREIGN_KEYS = (
    ForeignKey("products", "category_id", "categories", SET_NULL),
    ForeignKey("transactions", "customer_id", "customers", SET_NULL),
    ForeignKey("transactions", "cashier_id", "users", RESTRICT),
    ForeignKey("tx_details", "tx_id", "transactions", CASCADE),
    ForeignKey("tx_details", "product_id", "products", RESTRICT),
)


class Deleted(NamedTuple):
    tables: dict[str, DataFrame]
    decisions: DataFrame


def _children_first(names: list[str], keys: tuple[ForeignKey, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"foreign keys form a cycle through {name}")
        if name not in order:
            for k in keys:
                if k.parent == name and k.child != name:
                    visit(k.child, (*path, name))
            order.append(name)

    for n in names:
        visit(n, ())
    return order


def _pointing(child: DataFrame, column: str, gone: DataFrame, how: str) -> DataFrame:
    """Rows of ``child`` whose ``column`` is (left_semi) or is not (left_anti) a key of ``gone``."""
    return child.join(gone.select(F.col("key").alias("_gone")), F.col(column) == F.col("_gone"), how)


def delete_requested(
    tables: dict[str, DataFrame],
    requested: dict[str, DataFrame],
    keys: tuple[ForeignKey, ...] = FOREIGN_KEYS,
    protected: dict[str, tuple] | None = None,
    id_col: str = "id",
) -> Deleted:
    """New snapshots of all ``tables`` and a decision per requested key
    (table, key, decision): deleted, referenced, protected or no such row.

    ``requested`` maps a table to a frame whose first column holds keys; null and
    repeated keys count once or not at all.  Tables without ``id_col`` lose rows by
    cascade only.  Foreign keys must not form a cycle.
    """
    order = _children_first(list(tables), keys)
    asked = {t: df.select(F.col(df.columns[0]).alias("key")).where("key IS NOT NULL").distinct() for t, df in requested.items()}
    open_ = {}
    for t, df in asked.items():
        real = df.join(tables[t].select(F.col(id_col).alias("_id")), F.col("key") == F.col("_id"), "left_semi")
        held = (protected or {}).get(t, ())
        open_[t] = materialize(real.where(~F.col("key").isin(list(held))) if held else real)
    refused: dict[str, list[DataFrame]] = {t: [] for t in open_}
    while True:
        gone = _cascaded(tables, open_, order, keys, id_col)
        blocked: dict[str, DataFrame] = {}
        for t in order:
            if t not in gone:
                continue
            refs = []
            for k in keys:
                if k.parent != t or k.child not in tables:
                    continue
                child = tables[k.child]
                if k.action == RESTRICT:
                    left = _survivors(k.child, child, gone, keys, id_col)
                elif k.action == CASCADE and k.child in blocked:
                    left = _pointing(child, id_col, blocked[k.child], "left_semi")
                else:
                    continue
                refs.append(_pointing(left.select(k.column), k.column, gone[t], "left_semi").select(F.col(k.column).alias("key")))
            if refs:
                found = refs[0]
                for r in refs[1:]:
                    found = found.union(r)
                blocked[t] = materialize(found.distinct())
        newly = {t: materialize(open_[t].join(blocked[t], "key", "left_semi")) for t in open_ if t in blocked}
        newly = {t: df for t, df in newly.items() if not df.isEmpty()}
        if not newly:
            break
        for t, df in newly.items():
            refused[t].append(df)
            open_[t] = materialize(open_[t].join(df, "key", "left_anti"))
    return Deleted(_snapshots(tables, gone, keys, id_col), _decisions(asked, open_, refused, protected or {}))


def _cascaded(tables: dict, open_: dict, order: list[str], keys: tuple, id_col: str) -> dict[str, DataFrame]:
    """(key) frames of all rows with a key that go: requested or by cascade, parents first."""
    gone: dict[str, DataFrame] = {}
    for t in reversed(order):
        parts = [open_[t].select("key")] if t in open_ else []
        if id_col in tables[t].columns:
            for k in keys:
                if k.child == t and k.action == CASCADE and k.parent in gone:
                    parts.append(_pointing(tables[t], k.column, gone[k.parent], "left_semi").select(F.col(id_col).alias("key")))
        if parts:
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            gone[t] = out.distinct() if len(parts) > 1 else out
    return gone


def _survivors(name: str, table: DataFrame, gone: dict, keys: tuple, id_col: str) -> DataFrame:
    if name in gone:
        return _pointing(table, id_col, gone[name], "left_anti")
    for k in keys:
        if k.child == name and k.action == CASCADE and k.parent in gone and id_col not in table.columns:
            table = _pointing(table, k.column, gone[k.parent], "left_anti")
    return table


def _snapshots(tables: dict, gone: dict, keys: tuple, id_col: str) -> dict[str, DataFrame]:
    out = {}
    for name, table in tables.items():
        left = _survivors(name, table, gone, keys, id_col)
        for k in keys:
            if k.child == name and k.action == SET_NULL and k.parent in gone:
                salt = id_col if id_col in table.columns else table.columns[0]
                left = on_delete_set_null(left, gone[k.parent], k.column, salt)
        out[name] = left.select(*table.columns)
    return out


def _decisions(asked: dict, open_: dict, refused: dict, protected: dict) -> DataFrame:
    parts = []
    for t, df in asked.items():
        marked = df.join(open_[t].withColumn("_deleted", F.lit(True)), "key", "left")
        no = open_[t].limit(0)
        for r in refused[t]:
            no = no.union(r)
        marked = marked.join(no.withColumn("_refused", F.lit(True)), "key", "left")
        held = F.col("key").isin(list(protected[t])) if protected.get(t) else F.lit(False)
        decision = (
            F.when(F.col("_deleted"), DECISION_DELETED)
            .when(F.col("_refused"), DECISION_REFERENCED)
            .when(held, DECISION_PROTECTED)
            .otherwise(DECISION_MISSING)
        )
        parts.append(marked.select(F.lit(t).alias("table"), F.col("key").cast("long").alias("key"), decision.alias("decision")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
