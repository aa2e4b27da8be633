"""Sources and sinks: CSV round trip, JSON documents, schema drift, streaming ingest."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.plans import ingest, ledger
from tillspark.sources.documents import parse_sale_documents, read_sales_json, to_json_documents
from tillspark.sources.drift import resolve_columns
from tillspark.sources.export import read_csv, to_document, write_csv
from tillspark.streaming.ingest_stream import SalesIngestSink, start_sales_ingest


def test_csv_round_trip(spark, scratch):
    rows = [("a \"quoted\" name", "x,y", 1), ("multi\nline", "", 2), (None, "plain", 3)]
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("other", T.StringType()),
                           T.StructField("n", T.LongType())])
    df = spark.createDataFrame(rows, schema)
    path = os.path.join(scratch, "out")
    write_csv(df, path, header=["NAME", "OTHER", "N"])
    back = read_csv(spark, path, T.StructType([T.StructField("NAME", T.StringType()), T.StructField("OTHER", T.StringType()),
                                                T.StructField("N", T.LongType())])).collect()
    got = {r.N: (r.NAME, r.OTHER) for r in back}
    assert got[1] == ("a \"quoted\" name", "x,y")
    assert got[2][0] == "multi\nline" and got[2][1] in ("", None)
    assert got[3][0] in ("", None)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert '"a ""quoted"" name"' in text


def test_export_ledger_csv(seed, spark, scratch):
    rows = ledger.export_ledger_rows(seed["transactions"], seed["users"], seed["customers"], seed["tx_details"])
    out = rows.select(*ledger.EXPORT_LEDGER_COLUMNS)
    path = os.path.join(scratch, "ledger")
    write_csv(out, path, header=ledger.LEDGER_CSV_HEADER, single_file=True)
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(os.path.join(path, files[0])).read().splitlines()
    assert lines[0].split(",")[0] == "NO. TRANSAKSI" and len(lines) == 17
    first = {r.invoice_no: r for r in out.collect()}
    assert first["INV-0001"].date_text == "11/06/2026 09:30:00"
    assert first["INV-0002"].cashier_name == "Cashier 2" and first["INV-0002"].customer_name == "Umum"


def test_json_documents_round_trip(spark, seed):
    bodies = [json.dumps(_doc("INV-1", "2026-06-13", "08:00:00", [_item(1, 2), _item(3, 1)])),
              json.dumps(_doc("INV-2", "2026-06-13", "09:00:00", [])), "{not json"]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    parsed = parse_sale_documents(raw)
    by_inv = {r.invoice_no: r for r in parsed.collect()}
    assert len(by_inv["INV-1"].items) == 2 and by_inv["INV-2"].items == [] and None in by_inv
    again = parse_sale_documents(to_json_documents(parsed.where("invoice_no IS NOT NULL")))
    assert sorted(r.invoice_no for r in again.collect()) == ["INV-1", "INV-2"]
    headers, lines = ingest.split_documents(parsed.where("invoice_no IS NOT NULL"))
    assert {r.invoice_no: r.n_items for r in headers.collect()} == {"INV-1": 2, "INV-2": 0}
    assert lines.count() == 2
    doc = json.loads(to_document(seed["customers"].limit(1)).collect()[0].document)
    assert set(doc) == {"id", "name", "phone", "email", "address", "created_at"} and doc["email"] is None


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, "A", 2)], "id long, invoice_number string, cashier_id long")
    out = resolve_columns(df, {"invoice_no": ["invoiceNo", "invoice_number"], "cashier_id": ["cashierId"],
                               "customer_id": ["customerId"]})
    assert out.columns == ["id", "invoice_no", "cashier_id"]


def _doc(inv, date, time, items, total=3500, paid=5000):
    return {"invoice_no": inv, "date": date, "time": time, "cashier_id": 1, "customer_id": None,
            "subtotal": total, "discount_type": "flat", "discount_value": 0, "discount": 0,
            "total": total, "paid": paid, "change": paid - total, "items": items}


def _item(pid, qty, price=3500):
    return {"product_id": pid, "name": f"Product {pid}", "qty": qty, "price": price, "subtotal": qty * price}


def _batch(spark, scratch, docs, name="in"):
    path = os.path.join(scratch, name)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as fh:
        for d in docs:
            fh.write(json.dumps(d) + "\n")
    return path


def test_ingest_rules(spark, seed, scratch):
    docs = [
        _doc("INV-0001", "2026-06-13", "08:00:00", [_item(1, 1)]),  # already stored
        _doc("INV-A", "2026-06-13", "08:00:00", [_item(786526, 1)]),  # takes the last unit
        _doc("INV-B", "2026-06-13", "09:00:00", [_item(786526, 1)]),  # beyond remaining stock
        _doc("INV-C", "2026-06-13", "09:30:00", []),  # empty cart
        _doc("INV-D", "2026-06-13", "10:00:00", [_item(1, 1)], total=3500, paid=3000),  # underpaid
        _doc("inv-e", "2026-06-13", "11:00:00", [_item(1, 1), _item(1, 2)]),  # cart merge
        _doc("INV-E", "2026-06-13", "12:00:00", [_item(1, 1)]),  # duplicate in batch (later copy)
        _doc("INV-F", "2026-06-13", "13:00:00", [_item(999, 1)]),  # unknown product
        _doc("INV-G", "2026-06-13", "14:00:00", [_item(1, 1)], total=7500.5, paid=8000),  # rounding
    ]
    docs.append(docs[1])  # byte-identical re-post of INV-A: one document, two copies
    headers, lines = ingest.split_documents(read_sales_json(spark, _batch(spark, scratch, docs)))
    args = (headers, lines, seed["transactions"], seed["products"])
    dec = {r.invoice_no: (r.copies, r.decision) for r in ingest.ingest_decisions(*args).collect()}
    assert dec["INV-0001"] == (1, "already stored")
    assert dec["INV-A"] == (2, "accepted")
    assert dec["INV-B"] == (1, "insufficient stock")
    assert dec["INV-C"] == (1, "empty cart")
    assert dec["INV-D"] == (1, "paid below total")
    assert dec["inv-e"] == (2, "accepted")
    assert dec["INV-F"] == (1, "unknown product")
    heads = {r.invoice_no: r for r in ingest.ingest_headers(*args).collect()}
    assert sorted(heads) == ["INV-A", "INV-G", "inv-e"]
    assert sorted(r.id for r in heads.values()) == [17, 18, 19]
    assert heads["INV-G"].total == 7501
    out = ingest.ingest_lines(*args).collect()
    assert sum(1 for r in out if r.invoice_no == "inv-e") == 2
    assert sum(1 for r in out if r.invoice_no == "INV-A") == 1


def test_streaming_ingest(spark, seed, scratch):
    src = os.path.join(scratch, "stream-in")
    _batch(spark, scratch, [_doc("INV-S1", "2026-06-13", "08:00:00", [_item(786526, 1)])], "stream-in")
    sink = SalesIngestSink(seed["transactions"], seed["products"], os.path.join(scratch, "heads"),
                           os.path.join(scratch, "lines"))
    q = start_sales_ingest(spark, src, sink, os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    with open(os.path.join(src, "part-1.json"), "w") as fh:
        fh.write(json.dumps(_doc("INV-S2", "2026-06-13", "09:00:00", [_item(786526, 1)])) + "\n")
        fh.write(json.dumps(_doc("INV-S1", "2026-06-13", "08:00:00", [_item(1, 1)])) + "\n")
    q = start_sales_ingest(spark, src, sink, os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    heads = spark.read.parquet(os.path.join(scratch, "heads")).collect()
    # S1 accepted in epoch 0; S2 finds no stock left; S1 again is already stored.
    assert [r.invoice_no for r in heads] == ["INV-S1"]
    assert heads[0].date == dt.date(2026, 6, 13)


def test_snapshot_versions_and_month_pruning(spark, seed, scratch):
    from tillspark.operators.filters import period_filter
    from tillspark.sources.export import read_snapshot, with_month, write_snapshot

    root = os.path.join(scratch, "transactions")
    write_snapshot(with_month(seed["transactions"]), root, "0001", partition_by=["month"])
    changed = seed["transactions"].where("id <= 10")
    write_snapshot(with_month(changed), root, "0002", partition_by=["month"])
    snap = read_snapshot(spark, root)
    assert snap.count() == 10
    june = period_filter(snap, dt.date(2026, 6, 10), dt.date(2026, 6, 12))
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan
    assert june.count() == 8  # ids 1-3 and 6-10; 4 and 5 are dated before 06-10


def test_registered_exports_round_trip_through_csv(spark, scratch):
    import __spark_entry__ as entry
    from tillspark.plans import ledger as L

    sf = "/root/testdata/sf0.001"
    for key, header in (("export_ledger", L.LEDGER_CSV_HEADER), ("export_ledger_dateonly", L.LEDGER_DATEONLY_CSV_HEADER),
                        ("export_report", L.REPORT_CSV_HEADER)):
        df = entry.queries()[key](spark, sf)
        path = os.path.join(scratch, key)
        write_csv(df, path, header=header)
        schema = T.StructType([T.StructField(h, f.dataType) for h, f in zip(header, df.schema.fields)])
        back = read_csv(spark, path, schema).toDF(*df.columns)
        norm = lambda d: d.na.fill("", [c for c, t in d.dtypes if t == "string"])
        assert norm(back).exceptAll(norm(df)).count() == 0 and back.count() == df.count()


def test_read_model_round_trip(spark, seed, scratch):
    from tillspark.sources.export import with_month, write_snapshot
    from tillspark.sources.tables import read_model

    root = os.path.join(scratch, "warehouse")
    for name, df in seed.items():
        if name == "transactions":
            write_snapshot(with_month(df), os.path.join(root, name), "1", partition_by=["month"])
        else:
            df.write.parquet(os.path.join(root, name))
    m = read_model(spark, root)
    assert m["transactions"].count() == 16 and "month" in m["transactions"].columns
    assert dict(m["tx_details"].dtypes)["qty"] == "int"
    assert m["products"].count() == 16


def test_history_documents_written_as_json_lines(spark, seed, scratch):
    from tillspark.plans.crm import customer_history_doc
    from tillspark.sources.export import write_json

    docs = customer_history_doc(seed["customers"], seed["transactions"], seed["users"])
    path = os.path.join(scratch, "history")
    write_json(docs, path)
    back = spark.read.json(path).collect()
    assert len(back) == 4
    parsed = [json.loads(r.document) for r in back]
    assert {d["customer"]["id"] for d in parsed} == {1, 2, 3, 4}
    assert all("cashier_name" in d["transaction"] for d in parsed)


def test_replayed_epoch_replaces_its_output(spark, seed, scratch):
    src = _batch(spark, scratch, [_doc("INV-R1", "2026-06-13", "08:00:00", [_item(1, 1)]),
                                  _doc("INV-R2", "2026-06-13", "09:00:00", [_item(3, 2)])], "replay-in")
    batch = read_sales_json(spark, src)
    sink = SalesIngestSink(seed["transactions"], seed["products"], os.path.join(scratch, "rh"), os.path.join(scratch, "rl"))
    sink(batch, 0)
    sink(batch, 0)  # the same micro-batch delivered again after a failure
    heads = spark.read.parquet(os.path.join(scratch, "rh")).collect()
    assert sorted(r.invoice_no for r in heads) == ["INV-R1", "INV-R2"]
    assert spark.read.parquet(os.path.join(scratch, "rl")).count() == 2
    sink(batch, 1)  # a later epoch carrying the same invoices: already stored
    assert spark.read.parquet(os.path.join(scratch, "rh")).count() == 2


def test_newest_version_by_number_and_uri(spark, tmp_path):
    from tillspark.sources.export import latest_version, read_snapshot, write_snapshot

    root = f"file://{tmp_path}/t"
    assert latest_version(spark, root) is None
    for v in ("9", "10"):
        write_snapshot(spark.range(int(v)), root, v)
    assert latest_version(spark, root).endswith("version=10")
    assert read_snapshot(spark, root).count() == 10


def test_documents_without_invoice_get_their_own_decision(spark):
    from tillspark.plans import ingest
    from tillspark.schemas import SALE_DOCUMENT

    docs = spark.createDataFrame([_doc_without_invoice(1), _doc_without_invoice(2)], SALE_DOCUMENT)
    headers, _ = ingest.split_documents(docs)
    first = ingest.first_per_invoice(headers)
    assert first.count() == 2 and {r.copies for r in first.collect()} == {1}


def _doc_without_invoice(total):
    from tillspark.schemas import SALE_DOCUMENT

    return tuple(float(total) if f.name == "total" else None for f in SALE_DOCUMENT.fields)


def test_usernames_repeated_in_a_batch(spark):
    import datetime as dt

    from tillspark.plans.master_data import upsert_users

    users = spark.createDataFrame(
        [(1, "A", "ann", "x", "kasir", "active", None), (2, "B", "bob", "x", "kasir", "active", None)],
        "id long, name string, username string, password_digest string, role string, status string, created_at date",
    )
    changes = spark.createDataFrame(
        [(None, "C", "dup", "kasir", "active", "p"), (None, "D", "DUP ", "kasir", "active", "p"),
         (1, "A", "bob", "kasir", "active", ""), (2, "B2", "bob", "kasir", "active", "")],
        "id long, name string, username string, role string, status string, password string",
    )
    kept, rejected = upsert_users(users, changes, dt.date(2001, 7, 19))
    rows = {r.id: r.username for r in kept.collect()}
    assert rows[1] == "ann" and len(rows) == 3 and rows[3].strip().lower() == "dup"
    assert {r.errors for r in rejected.collect()} == {"username taken"} and rejected.count() == 2
