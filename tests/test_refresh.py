"""Incremental refresh and the sink's publication, against full recomputation."""

from __future__ import annotations

import json
import os
import random
import shutil
import uuid
from datetime import date, timedelta
from decimal import Decimal

import pytest
from ledger_rows import AS_OF, SF_SMALL, move

from caudal import schema as S
from caudal.operators import facts as X
from caudal.plans import catalog
from caudal.plans import publish as P
from caudal.session import file_names, shared_dir
from caudal.sources.ledger import Ledger
from caudal.sources.sinks import Refresh, published, read_report
from caudal.streaming import refresh as J

BUCKETS = 8


@pytest.fixture()
def work(spark):
    return f"{shared_dir(spark)}/caudal/test-refresh/{uuid.uuid4().hex}"


def _ledger(seed, n=300):
    """Documents of both types and states, paid or open, due or not, some undated, a hot partner."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        total = Decimal(rng.randint(100, 99999)) / 100
        residual = rng.choice([Decimal(0), total, total / 2, Decimal("-1.00")]).quantize(Decimal("0.01"))
        issued = rng.choice([AS_OF - timedelta(days=rng.randint(0, 420)), None] + [AS_OF - timedelta(days=rng.randint(0, 300))] * 8)
        due = rng.choice([None, (issued or AS_OF) + timedelta(days=rng.randint(0, 200))])
        paid = rng.choice([None, (issued or AS_OF) + timedelta(days=rng.randint(0, 90))])
        out.append((i, f"D/{i}", rng.choice([S.OUT_INVOICE, S.IN_INVOICE, "entry"]), rng.choice([S.POSTED, S.POSTED, "draft"]), issued,
                    due, total, residual, rng.choice(["Hot", "Hot", f"P{i % 17}"]), paid))
    return out


def _rows_of(df):
    return sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())


def _equals_full(spark, work, moves, extras, p, names=None):
    """What the tick published is what the operators give on the whole extract."""
    ctx = catalog.Ctx(spark, None, p, raw=Ledger(moves.coalesce(1), extras.payments, extras.journals))
    assert _rows_of(read_report(spark, f"{work}/reports", "staging", p.as_of)) == _rows_of(ctx.staged)
    for name in names or [*(n for n in P.BASE if n != "monthly_facts"), "monthly_net_cashflow", "collections_velocity"]:
        assert _rows_of(read_report(spark, f"{work}/reports", name, p.as_of)) == _rows_of(catalog.build(name, ctx)), name


SOME = ("kpi_bundle", "client_concentration", "critical_invoices", "kpi_bundle_v")


@pytest.fixture()
def extras(spark, journals):
    paid = [(i, AS_OF - timedelta(days=i), Decimal(i), S.OUTBOUND, S.POSTED, "P", None) for i in range(1, 9)]
    return Ledger(None, spark.createDataFrame(paid, S.PAYMENTS_SCHEMA), journals)


def test_ticks_equal_full_recomputation(spark, make_moves, extras, work):
    """Changed, vanished and new documents, a later date, the same extract again, a cleared former extract."""
    first = _ledger(1)
    second = [r for r in first if r[0] % 31] + [(1000 + r[0], f"N/{r[0]}", *r[2:]) for r in _ledger(2, 9)]
    second = [(*r[:7], Decimal(0), *r[8:]) if r[0] % 50 == 7 else r for r in second]
    second = [(*r[:6], r[6] + 1, r[7] + 1 if r[7] > 0 else r[7], *r[8:]) if r[0] % 40 == 3 else r for r in second]  # amounts alone
    third = [r for r in second if r[0] != 20]
    day = AS_OF + timedelta(days=1)
    changed = []
    for seq, (rows, when) in enumerate(((first, AS_OF), (second, AS_OF), (third, AS_OF), (third, day), (first, day)), 1):
        p = S.Params(as_of=when, top_clients=3, top_critical=5)
        J.write_extract(make_moves(rows), f"{work}/inbox", seq, when, BUCKETS)
        if seq == 5:
            shutil.rmtree(f"{work}/inbox/extract_seq=4")
        path = f"{work}/inbox/extract_seq={seq}/extract_date={when.isoformat()}"
        changed.append(J.refresh(spark, path, work, extras, p, BUCKETS))
        _equals_full(spark, work, make_moves(rows), extras, p)
    assert changed[0] is None and len(changed[1]) > 1 and len(changed[2]) == 1 and changed[3] == [] and changed[4] is None
    assert J.refresh(spark, path, work, extras, p, BUCKETS) == []
    _equals_full(spark, work, make_moves(first), extras, p, SOME)


def test_one_changed_row_reads_one_bucket(spark, make_moves, extras, work, monkeypatch):
    rows = _ledger(3)
    for seq, data in enumerate((rows, [(*r[:8], "Other", r[9]) if r[0] == 5 else r for r in rows]), 1):
        J.write_extract(make_moves(data), f"{work}/inbox", seq, AS_OF, BUCKETS)
    paths = [f"{work}/inbox/extract_seq={seq}/extract_date={AS_OF.isoformat()}" for seq in (1, 2)]
    p = S.Params(as_of=AS_OF)
    J.refresh(spark, paths[0], work, extras, p, BUCKETS)
    before = {f for f in published(spark, f"{work}/reports", AS_OF)["staging"]}
    read, plain = [], J.bucket_rows
    monkeypatch.setattr(J, "bucket_rows", lambda *a: read.append(plain(*a)) or read[-1])
    scanned = []
    monkeypatch.setattr(J, "digests", lambda *a: scanned.append(a))
    (bucket,) = J.refresh(spark, paths[1], work, extras, p, BUCKETS)
    files = {f for df in read for f in df.inputFiles()}
    assert read and not scanned and files and all(f"/bucket={bucket}/" in f for f in files)
    after = set(published(spark, f"{work}/reports", AS_OF)["staging"])
    assert len(after - before) == 1 == len(before - after)  # the other buckets' tables are not written again


def test_an_extract_like_the_one_before_publishes_nothing_new(spark, make_moves, extras, work):
    """Unless payments or journals changed: then the reports follow, and the staged table is not written again."""
    rows, p = _ledger(8, 40), S.Params(as_of=AS_OF)
    seen = []
    for seq in (1, 2, 3):
        J.write_extract(make_moves(rows), f"{work}/inbox", seq, AS_OF, BUCKETS)
        if seq == 3:
            extras = Ledger(None, extras.payments, extras.journals.withColumn("current_balance", extras.journals.current_balance + 1)
                            .select(*S.JOURNALS_SCHEMA.fieldNames()))
        J.refresh(spark, f"{work}/inbox/extract_seq={seq}/extract_date={AS_OF.isoformat()}", work, extras, p, BUCKETS)
        seen.append(published(spark, f"{work}/reports", AS_OF))
    assert seen[0] == seen[1] != seen[2] and seen[1]["staging"] == seen[2]["staging"]
    assert [n for n in os.listdir(f"{work}/state") if n.startswith("0")] and "extract_seq=3" in open(f"{work}/state/000000000003.json").read()
    _equals_full(spark, work, make_moves(rows), extras, p, SOME)


@pytest.mark.parametrize("delivered", [None, 4])
def test_extracts_by_other_hands(spark, make_moves, extras, work, delivered):
    """Without digests, or with other buckets, the job finds the changed buckets by itself."""
    rows = _ledger(4, 80)
    p = S.Params(as_of=AS_OF)
    for seq, data in enumerate((rows, rows[:-1]), 1):
        path = f"{work}/inbox/extract_seq={seq}/extract_date={AS_OF.isoformat()}"
        if delivered:
            J.write_extract(make_moves(data), f"{work}/inbox", seq, AS_OF, delivered)
        else:
            make_moves(data).write.parquet(path)
        changed = J.refresh(spark, path, work, extras, p, BUCKETS)
        _equals_full(spark, work, make_moves(data), extras, p, SOME)
    assert len(changed) == 1


def test_facts_are_summed_up_after_many_ticks(spark, make_moves, extras, work, monkeypatch):
    monkeypatch.setattr(J, "FACT_FOLDERS", 2)
    rows = _ledger(5, 60)
    p = S.Params(as_of=AS_OF)
    for seq in range(1, 5):
        J.write_extract(make_moves(rows[seq:]), f"{work}/inbox", seq, AS_OF, BUCKETS)
        J.refresh(spark, f"{work}/inbox/extract_seq={seq}/extract_date={AS_OF.isoformat()}", work, extras, p, BUCKETS)
        assert len(os.listdir(f"{work}/state/facts")) <= 4
    _equals_full(spark, work, make_moves(rows[4:]), extras, p, SOME)


def test_a_tick_that_dies_is_done_again(spark, make_moves, extras, work, monkeypatch):
    """Killed after its reports and before its state: the next try goes on from the state before."""
    rows, p = _ledger(6, 80), S.Params(as_of=AS_OF)
    for seq, data in enumerate((rows, rows[3:]), 1):
        J.write_extract(make_moves(data), f"{work}/inbox", seq, AS_OF, BUCKETS)
    paths = [f"{work}/inbox/extract_seq={seq}/extract_date={AS_OF.isoformat()}" for seq in (1, 2)]
    J.refresh(spark, paths[0], work, extras, p, BUCKETS)
    write = J.write_text
    monkeypatch.setattr(J, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        J.refresh(spark, paths[1], work, extras, p, BUCKETS)
    monkeypatch.setattr(J, "write_text", write)
    assert J.refresh(spark, paths[1], work, extras, p, BUCKETS)
    _equals_full(spark, work, make_moves(rows[3:]), extras, p, SOME)


def test_signed_facts_cancel(spark, make_moves):
    facts = X.ledger_facts(make_moves(_ledger(7)))
    assert facts.count() > 0 and X.summed(facts, X.signed(facts, -1)).count() == 0
    some, rest = X.ledger_facts(make_moves(_ledger(7)[:100])), X.ledger_facts(make_moves(_ledger(7)[100:]))
    both = X.summed(some, rest)
    assert sorted(map(str, both.collect())) == sorted(map(str, facts.select(*both.columns).collect()))
    assert facts.dtypes == both.dtypes


# -- the sink ------------------------------------------------------------------------------


def test_a_publication_that_dies_leaves_the_former_one(spark, work, monkeypatch):
    """Killed between two tables: a reader still sees the whole former set, the next try clears up."""
    def tables(n):
        return {f"t{k}": spark.range(n + k) for k in range(4)}

    def read():
        return [read_report(spark, work, f"t{k}", AS_OF).count() for k in range(4)]

    first = Refresh(spark, work, AS_OF)
    first.write_all(tables(1))
    with pytest.raises(LookupError):
        read()
    first.commit()
    assert read() == [1, 2, 3, 4]
    dying, write = Refresh(spark, work, AS_OF), Refresh.write
    monkeypatch.setattr(Refresh, "write", lambda self, name, df: write(self, name, df) if name < "t2" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        dying.write_all(tables(10))
    monkeypatch.setattr(Refresh, "write", write)
    assert read() == [1, 2, 3, 4] and len(os.listdir(f"{work}/t0/as_of={AS_OF.isoformat()}")) == 2
    for n in (20, 30, 40):
        again = Refresh(spark, work, AS_OF)
        again.write_all(tables(n))
        again.commit()
        assert read() == [n, n + 1, n + 2, n + 3]
        assert len(os.listdir(f"{work}/t0/as_of={AS_OF.isoformat()}")) == 2  # what died is gone, the former one kept
    assert len([n for n in os.listdir(f"{work}/_published/as_of={AS_OF.isoformat()}") if n.endswith(".json")]) == 2


def test_a_reader_of_the_former_set_can_finish(spark, work):
    for n in (1, 2):
        tables = Refresh(spark, work, AS_OF)
        tables.write("t", spark.range(n))
        before = read_report(spark, work, "t", AS_OF) if n > 1 else None
        tables.commit()
    assert before.count() == 1 and read_report(spark, work, "t", AS_OF).count() == 2


def test_dates_are_apart(spark, work):
    for k, day in enumerate((AS_OF, date(2001, 1, 1))):
        tables = Refresh(spark, work, day)
        tables.write("t", spark.range(k + 1))
        tables.commit()
    assert [read_report(spark, work, "t", d).count() for d in (AS_OF, date(2001, 1, 1))] == [1, 2]
    assert json.dumps(published(spark, work, date(1999, 1, 1))) == "null"


def test_no_bucket_passes_through_one_task(spark, make_moves):
    """Each task writes its own rows of a bucket; the extract holds all of them and their digests."""
    work = f"{shared_dir(spark)}/caudal/test-refresh/{uuid.uuid4().hex}"
    moves = make_moves([move(i) for i in range(400)]).repartitionByRange(4, "id")
    J.write_extract(moves, work, 1, AS_OF, 2)
    path = f"{work}/extract_seq=1/extract_date={AS_OF.isoformat()}"
    assert [len(file_names(spark, f"{path}/{b}")) for b in ("bucket=0", "bucket=1")] == [4, 4]
    assert sorted(r.id for r in J.bucket_rows(spark, path, None, 2).collect()) == list(range(400))
    assert J.extract_digests(spark, path, 2) == J.digests(moves, 2)


def test_registered_stream_reads_the_mapping_once(spark, monkeypatch):
    """The former extract, and the payments of every tick, come from the extract written first."""
    from caudal.sources import tables

    written = []
    real = J.write_extract
    monkeypatch.setattr(J, "write_extract", lambda moves, *a, **k: (written.append(moves.inputFiles()), real(moves, *a, **k)))
    monkeypatch.setattr(J, "_RUNS", {})
    raw = tables.Ledger(tables.map_moves(spark, SF_SMALL), None, tables.map_journals(spark, SF_SMALL, AS_OF))
    monkeypatch.setattr(tables, "mapped_ledger", lambda *a: raw)
    assert J.refresh_stream_query(spark, SF_SMALL).count() == 5
    assert [any(f"{SF_SMALL}/" in f for f in files) for files in written] == [True, False]
