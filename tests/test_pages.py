"""Page files as a data source, and columns whose names change over time."""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pyarrow as pa
import pytest
from ledger_rows import AS_OF, SF_SMALL, move
from pyspark.sql import functions as F

from caudal import schema as S
from caudal.plans import catalog
from caudal.session import shared_dir
from caudal.sources import pages as pages_module
from caudal.sources.history import Renamed, resolve, source_column
from caudal.sources.ledger import Ledger
from caudal.sources.pages import PagesReader, PagesWriter, field_text, load_pages, read_pages
from caudal.sources.sinks import read_report
from caudal.streaming import refresh as J

RECORD = {"id": 1, "name": "F/1", "move_type": "out_invoice", "state": "posted", "invoice_date": "2001-07-01", "invoice_date_due": False,
          "amount_total": 100.10, "amount_residual": 0.3, "partner_id": [7, "Acme \"X\""], "payment_date": False}


@pytest.fixture()
def pages(tmp_path):
    def write(*lists, table="moves"):
        for t in ("moves", "payments", "journals"):
            (tmp_path / t).mkdir(exist_ok=True)
        for i, records in enumerate(lists):
            (tmp_path / table / f"page{i}.json").write_text(json.dumps(records))
        (tmp_path / table / "_SUCCESS").write_text("")
        return str(tmp_path)
    return write


def test_pages_as_the_server_returns_them(spark, pages):
    path = pages([RECORD, {**RECORD, "id": 2, "partner_id": False, "invoice_date": False}], [], [{**RECORD, "id": 3, "extra": [1]}, {"id": 4}])
    raw = read_pages(spark, path, "moves")
    assert raw.rdd.getNumPartitions() == 3  # a partition per page
    got = {r.id: r for r in load_pages(spark, path).moves.filter("id < 4").collect()}
    assert (float(got[1].amount_total), float(got[1].amount_residual), got[1].partner_name, got[1].date_maturity) == (100.1, 0.3, 'Acme "X"', None)
    assert (got[2].partner_name, got[2].invoice_date) == (S.NO_PARTNER, None) and got[3].invoice_date == date(2001, 7, 1)
    with pytest.raises(Exception, match="moves: unreadable amount_total"):
        load_pages(spark, path).moves.collect()


def test_filters_are_taken_over_by_the_reader(spark, pages, capsys):
    path = pages([RECORD, {**RECORD, "id": 2, "state": "draft"}, {**RECORD, "id": 3, "move_type": "entry"}],
                 [{**RECORD, "id": 4, "invoice_date": "1999-01-01"}, {**RECORD, "id": 5, "invoice_date": False}, {**RECORD, "id": 6, "state": None}])
    moves = load_pages(spark, path, since="2000-08-01").moves
    assert [r.id for r in moves.collect()] == [1]
    moves.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and all(x in plan.split("PushedFilters")[1].split("\n")[0] for x in ("move_type", "state", "invoice_date"))
    left = [x for x in plan.split("\n") if x.startswith("Condition")]
    assert all("move_type" not in x and "posted" not in x for x in left)  # Spark does not check them again


def test_reader_filters_are_sparks(spark, pages):
    """Whatever is pushed, the rows are those that Spark's own filter keeps."""
    values = [None, "", "a", "b", "false", "é", "2001-07-01"]
    path = pages([{**RECORD, "id": i, "state": v} for i, v in enumerate(values)])
    raw, kept = read_pages(spark, path, "moves"), read_pages(spark, path, "moves").persist()
    kept.count()
    for condition in ("state = 'a'", "state in ('a', 'false')", "state >= 'a'", "state is not null", "state >= '2001-07-01' and state <> 'b'",
                      "not state = 'a'", "state is null", "state > 'a' or id = '0'"):
        assert sorted(r.id for r in raw.filter(condition).collect()) == sorted(r.id for r in kept.filter(F.expr(condition)).collect()), condition
    kept.unpersist()


def test_unreadable_page_fails(spark, pages):
    path = pages([RECORD])
    with open(f"{path}/moves/page9.json", "w") as f:
        f.write('[{"id": 1')
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        read_pages(spark, path, "moves").collect()


def test_pages_of_the_registered_export(spark):
    path = catalog._paged(catalog.context(spark, SF_SMALL))
    raw = read_pages(spark, path, "moves")
    assert raw.rdd.getNumPartitions() == len(PagesReader(f"{path}/moves", S.RAW_MOVES_SCHEMA).partitions()) > 1


def test_pages_are_cut_by_each_task_and_compressed(spark, tmp_path):
    """No page is larger than asked for, none is lost, and the files take a fraction of the text they hold."""
    i = F.col("id").cast("string")
    rows = spark.range(0, 2500, 1, 3).select(i.alias("id"), F.lit("F").alias("name"), F.lit("a \"b\"").alias("state"), F.when(
        F.col("id") != 7, F.concat(F.lit("["), i, F.lit(', "Acme"]'))).alias("partner_id"))
    catalog.write_pages(rows, f"{tmp_path}/moves", 100)
    catalog.write_pages(rows.limit(0), f"{tmp_path}/payments", 100)
    reader = PagesReader(f"{tmp_path}/moves", S.RAW_MOVES_SCHEMA)
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert max(sizes) == 100 and sum(sizes) == 2499 and len(sizes) <= 25 + 3  # a row without its pair is no record
    assert {p.suffix for p in (tmp_path / "moves").glob("part-*")} == {".gz"}
    got = {r.id: r for r in read_pages(spark, str(tmp_path), "moves").collect()}
    assert set(got) == {str(k) for k in range(2500) if k != 7}
    assert (got["9"].state, json.loads(got["9"].partner_id), got["9"].invoice_date) == ('a "b"', [9, "Acme"], None)
    assert read_pages(spark, str(tmp_path), "payments").count() == 0


def test_many_pages_share_tasks(spark, pages):
    """Far more pages than tasks are worth: runs of pages go to one task, each page to one run, and no row is lost."""
    path = pages(*([{**RECORD, "id": 3 * k + j, "state": "draft" if j else "posted"} for j in range(3)] for k in range(200)))
    reader = PagesReader(f"{path}/moves", S.RAW_MOVES_SCHEMA)
    tasks = reader.partitions()
    assert 64 <= len(tasks) < 100 and len({p for t in tasks for p in t.value}) == sum(len(t.value) for t in tasks) == 200
    assert {b.num_rows for t in tasks for b in reader.read(t)} == {3}  # a page at a time
    assert sorted(r.id for r in load_pages(spark, path).moves.collect()) == list(range(600))
    assert sorted(r.id for r in load_pages(spark, path, since="2001-01-01").moves.collect()) == list(range(0, 600, 3))
    assert load_pages(spark, path).payments.count() == 0  # a folder without pages


def test_fields_of_any_kind_are_text(pages):
    """Fields that are text in every record are taken as they are, others one by one; pairs as ``json.dumps`` writes them."""
    values = ["a", None, False, True, 7, 2 ** 70, Decimal("1.50"), [7, "é \"X\" \\ \n"], [7], [7, 8], [True, "x"], ["7", "x"], [7, "x", 1], {"a": 1}]
    kept = [v if v is None or isinstance(v, str) else str(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else json.dumps(v) for v in values]
    assert [field_text(v) for v in values] == kept
    path = pages([{**RECORD, "state": v} for v in values if not isinstance(v, Decimal)])
    reader = PagesReader(f"{path}/moves", S.RAW_MOVES_SCHEMA)
    got = [b.column(3).to_pylist() for t in reader.partitions() for b in reader.read(t)]
    assert got == [[k for k, v in zip(kept, values) if not isinstance(v, Decimal)]]
    assert pages_module._column([Decimal("1.50"), None, "a"]).to_pylist() == ["1.50", None, "a"]


def test_pages_of_lost_attempts_do_not_count(tmp_path, monkeypatch):
    """Of a task's attempts only the committed one is read, and nothing hidden stays; a second write adds to the first."""
    def attempt(writer, number, *ids):
        monkeypatch.setattr(pages_module.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: number))
        return writer.write(iter([pa.RecordBatch.from_arrays([pa.array([f'{{"id": "{i}"}}' for i in ids])], names=["record"])]))

    def ids():
        reader = PagesReader(str(tmp_path), S.RAW_MOVES_SCHEMA)
        return [b.column(0).to_pylist() for t in reader.partitions() for b in reader.read(t)]

    first, second, third = (PagesWriter(str(tmp_path), 2) for _ in range(3))
    attempt(first, 1, 1, 2)
    done = attempt(first, 2, 1, 2, 3)
    assert ids() == [] and done.pages == 2  # not before the commit
    first.commit([done, None])
    assert ids() == [["1", "2"], ["3"]] and len(list(tmp_path.iterdir())) == 2
    second.commit([attempt(second, 2, 4)])
    third.abort([attempt(third, 2, 5)])
    assert sorted(ids()) == [["1", "2"], ["3"], ["4"]] and len(list(tmp_path.iterdir())) == 3


# -- columns over time ---------------------------------------------------------------------


HISTORY = (Renamed("moves", "date_maturity", "due_on", date(2001, 8, 1)), Renamed("moves", "date_maturity", "due_at", date(2001, 8, 3)),
           Renamed("moves", "partner_name", "customer", date(2001, 8, 1)))


def test_the_newest_name_in_force_counts():
    def name(have, day):
        return source_column("moves", "date_maturity", have, day, HISTORY)
    assert name({"date_maturity", "due_on"}, date(2001, 7, 31)) == "date_maturity"
    assert name({"date_maturity", "due_on"}, date(2001, 8, 2)) == "due_on"
    assert name({"due_at", "due_on"}, date(2001, 8, 2)) == "due_on" and name({"due_at", "due_on"}, date(2001, 8, 3)) == "due_at"
    assert name({"date_maturity"}, date(2001, 8, 3)) == "date_maturity" and name({"x"}, date(2001, 8, 3)) is None
    assert source_column("journals", "current_balance", {"balance"}, AS_OF) == "balance"


def test_a_missing_required_column_is_named(spark, make_moves):
    with pytest.raises(ValueError, match="amount_total"):
        resolve(make_moves([move(1)]).drop("amount_total"), "moves", S.MOVES_SCHEMA, AS_OF)


def test_stream_over_extracts_with_other_columns(spark, make_moves, journals):
    """The second week renames two columns, drops the payment date and adds one: its reports are those of the same rows
    under the ledger's names, and the unchanged rows change no bucket's digest."""
    work = f"{shared_dir(spark)}/caudal/test-history/{uuid.uuid4().hex}"
    extras, next_day = Ledger(None, spark.createDataFrame([], S.PAYMENTS_SCHEMA), journals), AS_OF + timedelta(days=1)
    rows = [move(i, residual="20.00" if i % 3 else "0.00", partner=f"P{i % 4}", due=AS_OF - timedelta(days=i)) for i in range(1, 30)]
    weeks = [(AS_OF - timedelta(days=1), make_moves(rows)), (AS_OF, make_moves(rows)), (next_day, make_moves(rows[:-1]))]
    changed = []
    for seq, (day, moves) in enumerate(weeks, 1):
        path = f"{work}/inbox/extract_seq={seq}/extract_date={day.isoformat()}"
        delivered = moves if seq == 1 else (moves.withColumnsRenamed({"date_maturity": "due_on", "partner_name": "customer"})
                                            .drop("payment_date").withColumn("added", F.lit(1)))
        delivered.coalesce(1).write.parquet(path)
        p = S.Params(as_of=day)
        changed.append(J.refresh(spark, path, work, extras, p, 4, HISTORY))
        ctx = catalog.Ctx(spark, None, p, raw=Ledger(moves, extras.payments, journals))
        for name in ("aging_report", "client_concentration", "critical_invoices", "kpi_bundle"):
            got, want = read_report(spark, f"{work}/reports", name, day), catalog.build(name, ctx)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name
    assert changed[0] is None and changed[1] == [] and len(changed[2]) == 1
