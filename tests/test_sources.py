from __future__ import annotations

import json
import tempfile
from datetime import date

import pytest
from ledger_rows import AS_OF, SF_SMALL, move

from caudal import schema as S
from caudal.plans import catalog
from caudal.sources import decode
from caudal.sources.ledger import load_ledger, moves_source, payments_source, undated_documents
from pyspark.sql import functions as F


def test_many2one_decoding(spark):
    df = spark.createDataFrame([('[7, "Acme"]',), ("false",), ("[7]",), (None,), ("junk",)], "p string")
    got = [r[0] for r in df.select(decode.many2one_name(F.col("p"), S.NO_PARTNER)).collect()]
    assert got == ["Acme", S.NO_PARTNER, S.NO_PARTNER, S.NO_PARTNER, S.NO_PARTNER]
    journal = [r[0] for r in df.select(decode.many2one_name(F.col("p"), S.UNKNOWN_JOURNAL)).collect()]
    assert journal[0] == "Acme" and journal[1] == S.UNKNOWN_JOURNAL


def test_lenient_dates_and_money(spark):
    df = spark.createDataFrame([("2001-07-31", "12.50"), ("false", "abc"), ("", None), ("2001-07-31 00:00:00", "1"),
                                ("2001-07-31T10:00:00", "1"), ("2001-7-1", "1"), ("31/07/2001", "1")], "d string, m string")
    got = df.select(decode.lenient_date(F.col("d")).alias("d"), decode.lenient_money(F.col("m")).alias("m")).collect()
    day = date(2001, 7, 31)
    assert [r.d for r in got] == [day, None, None, day, day, date(2001, 7, 1), None]
    assert [float(r.m) for r in got[:3]] == [12.5, 0.0, 0.0]


MOVE = {"id": "1", "name": "INV/1", "move_type": "out_invoice", "state": "posted", "invoice_date": "2001-07-01",
        "invoice_date_due": "false", "amount_total": "10.00", "amount_residual": "10.00", "partner_id": "false",
        "payment_date": "false"}
PAYMENT = {"id": "1", "date": "2001-07-20", "amount": "5.00", "payment_type": "inbound", "state": "posted",
           "partner_id": [9, "Acme"], "journal_id": [3, "Banco"]}
JOURNAL = {"id": "1", "name": "Banco", "type": "bank", "current_balance": "abc"}


def _export(tmp_path, moves=(MOVE,), payments=(PAYMENT,), journals=(JOURNAL,)):
    for name, rows in (("moves", moves), ("payments", payments), ("journals", journals)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path)


def test_erp_export(spark, tmp_path):
    second = {**MOVE, "id": "2", "state": "draft", "invoice_date": "2001-07-02 00:00:00", "invoice_date_due": "2001-08-01",
              "partner_id": '[3, "Beta"]', "payment_date": "2001-07-20"}
    led = load_ledger(spark, _export(tmp_path, (MOVE, second), (PAYMENT, {**PAYMENT, "id": "2", "journal_id": "false"},
                                                               {**PAYMENT, "id": "3", "journal_id": [3]})), "erp-json")
    m = {r.id: r for r in led.moves.collect()}
    assert m[1].partner_name == S.NO_PARTNER and m[1].date_maturity is None
    assert m[2].partner_name == "Beta" and m[2].payment_date == date(2001, 7, 20) and m[2].invoice_date == date(2001, 7, 2)
    assert float(led.journals.collect()[0].current_balance) == 0.0
    assert [r.id for r in moves_source(led.moves, AS_OF).collect()] == [1]  # draft filtered at the source
    got = {r.id: (r.partner_name, r.journal_tipo, float(r.amount)) for r in payments_source(led.payments, AS_OF).collect()}
    assert got == {1: ("Acme", "Banco", 5.0), 2: ("Acme", S.UNKNOWN_JOURNAL, 5.0), 3: ("Acme", S.UNKNOWN_JOURNAL, 5.0)}


@pytest.mark.parametrize("bad", [{"amount_residual": "abc"}, {"amount_total": "12345678901234567890.00"},
                                 {"amount_total": None}, {"id": "x"}])
def test_unreadable_documents_fail_the_load(spark, tmp_path, bad):
    led = load_ledger(spark, _export(tmp_path, (MOVE, {**MOVE, **bad})), "erp-json")
    with pytest.raises(Exception, match="unreadable"):
        led.moves.collect()


def test_unreadable_payment_fails_the_load(spark, tmp_path):
    led = load_ledger(spark, _export(tmp_path, payments=({**PAYMENT, "amount": "abc"},)), "erp-json")
    with pytest.raises(Exception, match="unreadable amount"):
        led.payments.collect()


@pytest.mark.parametrize("total", ["abc", ""])
def test_malformed_csv_fails_the_load(spark, tmp_path, total):
    for name, text in (("moves", "id,name,move_type,state,invoice_date,date_maturity,amount_total,amount_residual,partner_name\n"
                                 f"1,INV/1,out_invoice,posted,2001-07-01,2001-07-31,{total},10.00,Acme\n"),
                       ("payments", "id,date,amount,payment_type,state\n"), ("journals", "id,name,type,balance\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
    led = load_ledger(spark, str(tmp_path), "csv")
    with pytest.raises(Exception):
        led.moves.collect()


def test_every_document_of_the_window_is_kept(spark, make_moves):
    assert moves_source(make_moves([move(i) for i in range(1, 6)]), AS_OF).count() == 5


def test_undated_documents_are_counted_before_any_window(spark, make_moves):
    m = make_moves([move(1), move(2, invoice=None), move(3, "in_invoice", invoice=None), move(4, "in_invoice", invoice=None)])
    assert {r.move_type: r.n_undated for r in undated_documents(m).collect()} == {"out_invoice": 1, "in_invoice": 2}


def test_loaded_ledger_keeps_its_period_folders(spark, make_moves, journals, tmp_path):
    m = make_moves([move(i, invoice=date(1999 + i, 7, 1)) for i in range(3)])
    (m.withColumn(S.INVOICE_PERIOD, F.date_format("invoice_date", S.PERIOD_PATTERN))
     .write.partitionBy(*S.LEDGER_PARTITIONS).parquet(f"{tmp_path}/moves"))
    (spark.createDataFrame([], S.PAYMENTS_SCHEMA).withColumn(S.PAYMENT_PERIOD, F.lit("2001"))
     .write.parquet(f"{tmp_path}/payments"))
    journals.write.parquet(f"{tmp_path}/journals")
    led = load_ledger(spark, str(tmp_path))
    df = moves_source(led.moves, AS_OF)
    assert [r.id for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert S.INVOICE_PERIOD in filters[:filters.index("]")]


def test_conform_adds_optional_and_rejects_missing_required(spark, make_moves):
    from caudal.sources.ledger import conform
    m = make_moves([]).drop("payment_date")
    out = conform(m, S.MOVES_SCHEMA)
    assert out.columns == S.MOVES_SCHEMA.fieldNames()
    assert out.schema["payment_date"].dataType.typeName() == "date"
    with pytest.raises(ValueError):
        conform(m.drop("amount_total"), S.MOVES_SCHEMA)


def test_parquet_ledger_without_optional_column(spark, make_moves, journals):
    d = tempfile.mkdtemp(prefix="caudal-pq-")
    make_moves([move(1)]).drop("payment_date").write.parquet(f"{d}/moves")
    journals.write.parquet(f"{d}/journals")
    spark.createDataFrame([], S.PAYMENTS_SCHEMA).drop("journal_tipo").write.parquet(f"{d}/payments")
    led = load_ledger(spark, d)
    assert led.moves.collect()[0].payment_date is None
    assert led.payments.columns == S.PAYMENTS_SCHEMA.fieldNames()


def test_partner_lookup_and_journal_rename(spark, make_moves):
    from caudal.sources.ledger import attach_partner_names
    m = make_moves([move(1), move(2)]).withColumn("partner_id", F.col("id") * 10)
    partners = spark.createDataFrame([(10, "Acme")], "partner_id long, partner_name string")
    got = {r.id: r.partner_name for r in attach_partner_names(m, partners).collect()}
    assert got == {1: "Acme", 2: S.NO_PARTNER}
    d = tempfile.mkdtemp(prefix="caudal-csv-")
    import os
    for sub, text in (("moves", "id,name,move_type,state,invoice_date,date_maturity,amount_total,amount_residual,partner_name\n"
                                "1,INV/1,out_invoice,posted,2001-07-01,2001-07-31,10.00,10.00,Acme\n"),
                      ("payments", "id,date,amount,payment_type,state\n"),
                      ("journals", "id,name,type,balance\n1,Banco,bank,12.50\n")):
        os.makedirs(f"{d}/{sub}")
        with open(f"{d}/{sub}/part.csv", "w") as fh:
            fh.write(text)
    led = load_ledger(spark, d, fmt="csv")
    assert float(led.journals.collect()[0].current_balance) == 12.5
    assert led.moves.collect()[0].payment_date is None


@pytest.mark.parametrize("fmt", ["csv", "json", "erp-json", "faulty"])
def test_text_copies_are_compressed(spark, fmt):
    """Written and read back at a fraction of the text's size, whole."""
    ctx = catalog.context(spark, SF_SMALL)
    copy = catalog._sifted(ctx).ledger if fmt == "faulty" else catalog._reloaded(ctx, fmt)
    for df in (copy.moves, copy.payments, copy.journals):
        assert df.inputFiles() and all(f.endswith(".gz") for f in df.inputFiles())
    if fmt != "faulty":
        assert (copy.moves.count(), copy.payments.count()) == (ctx.raw.moves.count(), ctx.raw.payments.count())
