"""Rows that cannot be read are set aside with a reason, counted in the pass, and bounded."""

from __future__ import annotations

import uuid

import pytest
from ledger_rows import AS_OF

from caudal import schema as S
from caudal.operators import projection as P
from caudal.operators.staging import stage
from caudal.plans.publish import publish
from caudal.session import shared_dir
from caudal.sources.rejects import TooManyRejects, sift_ledger
from caudal.sources.sinks import published, read_report

MOVE = ('{{"id": "{id}", "name": "F/{id}", "move_type": "out_invoice", "state": "posted", "invoice_date": "{day}", '
        '"invoice_date_due": "2001-07-31", "amount_total": "{total}", "amount_residual": "10.00", "partner_id": "[1, \\"A\\"]", '
        '"payment_date": "false"}}')
GOOD = {"day": "2001-07-01", "total": "100.00"}


@pytest.fixture()
def folder(spark):
    path = f"{shared_dir(spark)}/caudal/test-rejects/{uuid.uuid4().hex}"

    def write(moves, payments=(), journals=('{"id": "1", "name": "B", "type": "bank", "current_balance": "abc"}',), names=(None,) * 3):
        for name, lines in zip(("moves", "payments", "journals"), (moves, payments, journals)):
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
        return path
    return write


LINES = [MOVE.format(id=1, **GOOD), MOVE.format(id="x", **GOOD), MOVE.format(id=3, day="n/a", total="7.00"),
         MOVE.format(id=4, day="2001-07-01", total="12,5"), MOVE.format(id=5, **GOOD)[:60], "no json", '{"name": "F/7", "amount_total": "1.00"}',
         MOVE.format(id=8, day="2001-07-01", total="9" * 30)]
REASONS = {"unreadable id": 1, "unreadable amount_total": 2, "malformed": 2, "missing id": 1}


def test_erp_rows_are_sifted(spark, folder):
    sifted = sift_ledger(spark, folder(LINES, ['{"id": "P1", "date": "n/a", "amount": "1.00", "payment_type": "inbound", "state": "posted"}']))
    assert sorted((r.id, r.invoice_date is None) for r in sifted.ledger.moves.collect()) == [(1, False), (3, True)]
    assert sifted.ledger.payments.collect() == [] and [float(r.current_balance) for r in sifted.ledger.journals.collect()] == [0.0]
    assert sifted.counts() == {"moves": REASONS, "payments": {"unreadable id": 1}, "journals": {}}
    rows = sifted.rejects.collect()
    by = {}
    for r in rows:
        if r.table_name == "moves":
            by[r.reason] = by.get(r.reason, 0) + 1
    assert by == REASONS and {r.record for r in rows if r.reason == "malformed"} == {LINES[4], "no json"}
    assert {(r.reason, r.id) for r in rows if r.reason != "malformed"} == {
        ("unreadable id", "x"), ("unreadable amount_total", "4"), ("unreadable amount_total", "8"), ("missing id", None), ("unreadable id", "P1")}
    assert sifted.check(7) == 7
    with pytest.raises(TooManyRejects, match="7 rows rejected, 6 allowed"):
        sifted.check(6)


def test_counted_in_the_pass_that_reads(spark, folder):
    """A filter or a pruned column above does not change what is counted."""
    sifted = sift_ledger(spark, folder(LINES))
    assert sifted.ledger.moves.filter("id = 1").select("name").collect()[0][0] == "F/1"
    assert sifted.observations["moves"].get["malformed"] == 2 and sum(sifted.observations["moves"].get.values()) == 6


def test_csv_rows_are_sifted(spark, folder):
    head = "id,name,move_type,state,invoice_date,date_maturity,amount_total,amount_residual,partner_name"
    good = "1,F/1,out_invoice,posted,2001-07-01,2001-07-31,100.00,0.00,A"
    lines = [head, good, good.replace("1,F", "x,F"), "2,F/2", good + ",too,many", good.replace("2001-07-01", "someday"),
             good.replace(",posted", ","), "5,F/5,in_invoice,draft,,,1.00,1.00,B"]
    sifted = sift_ledger(spark, folder(lines, ["id,date,amount,payment_type,state,partner_name", ",2001-07-01,5.00,inbound,posted,"],
                                       ["id,name,type,balance", "1,B,bank,10.50", "2,C,cash,?"]), "csv")
    assert sorted(r.id for r in sifted.ledger.moves.collect()) == [1, 5]
    assert [r.id for r in sifted.ledger.payments.collect()] == [None]
    assert [(r.id, float(r.current_balance)) for r in sifted.ledger.journals.collect()] == [(1, 10.5)]
    assert sifted.counts() == {"moves": {"malformed": 2, "unreadable id": 1, "unreadable invoice_date": 1, "missing state": 1},
                               "payments": {}, "journals": {"unreadable current_balance": 1}}
    assert sifted.ledger.moves.schema.names == S.MOVES_SCHEMA.names


def test_publish_beyond_the_threshold_publishes_nothing(spark, folder):
    path, out = folder(LINES), f"{shared_dir(spark)}/caudal/test-rejects/{uuid.uuid4().hex}"
    sifted = sift_ledger(spark, path)
    with pytest.raises(TooManyRejects):
        publish(spark, sifted.ledger, out, S.Params(as_of=AS_OF), sifted, 5)
    assert published(spark, out, AS_OF) is None
    sifted = sift_ledger(spark, path)
    publish(spark, sifted.ledger, out, S.Params(as_of=AS_OF), sifted, 6)
    assert read_report(spark, out, "rejects", AS_OF).count() == 6
    assert read_report(spark, out, "undated_documents", AS_OF).first().n_undated == 1


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError, match="parquet"):
        sift_ledger(spark, "/nowhere", "parquet")


# -- break-even rate -----------------------------------------------------------------------


@pytest.mark.parametrize("dues,want", [
    ([], (0.0, 0)), ([("out", 3, "100.00")], (0.0, 0)), ([("in", 3, "1400.00")], (0.0, 0)), ([("in", 3, "1500.00")], (None, None)),
    ([("out", 2, "1000.00"), ("in", 3, "1500.00")], (0.0, 5)), ([("out", 2, "1000.00"), ("in", 3, "1800.00")], (30.0, 35)),
    ([("out", 2, "3.00"), ("in", 3, "1501.00")], (33.333334, 35)), ([("out", 2, "1000.00"), ("in", 3, "2500.00")], (100.0, None)),
    ([("out", 2, "1000.00"), ("in", 3, "1750.00"), ("out", 9, "1000.00"), ("in", 9, "150.00")], (25.0, 30)),
    ([("in", 3, "1600.00"), ("out", 4, "9000.00")], (None, None)), ([("out", 2, "1000.00"), ("in", 90, "9000.00")], (0.0, 0)),
])
def test_break_even_rate(spark, make_moves, journals, dues, want):
    """Opening 1500: against hand-made cases and the grid's answer."""
    from datetime import timedelta

    from ledger_rows import move
    rows = [move(0, residual="0.00")] + [move(i, f"{kind}_invoice", residual=x, total=x, due=AS_OF + timedelta(days=d))
                                         for i, (kind, d, x) in enumerate(dues, 1)]
    staged = stage(make_moves(rows), AS_OF)
    r = P.break_even_rate(spark, staged, journals, AS_OF).first()
    assert (r.break_even_pct, r.min_cobrabilidad_pct) == want
    assert r.min_cobrabilidad_pct == P.min_collection_rate(spark, staged, journals, AS_OF).first().min_cobrabilidad_pct


def test_break_even_without_documents(spark, make_moves, journals):
    assert tuple(P.break_even_rate(spark, stage(make_moves([]), AS_OF), journals, AS_OF).first()) == (None, None)
