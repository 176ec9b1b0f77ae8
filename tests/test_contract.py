"""Driver contract, oracle agreement, stream = batch, and plan shape."""

from __future__ import annotations

import contextlib
import io
import math
import os
import re
import uuid
from dataclasses import replace
from datetime import date, timedelta

import duckdb
import pytest
from ledger_rows import AS_OF, SF_SMALL, move
from pyspark.sql import functions as F

import __spark_entry__ as E
from caudal import schema as S
from caudal.operators import facts as X
from caudal.operators.staging import stage
from caudal.plans import catalog, oracle
from caudal.plans.publish import REPORTS, TABLES as WINDOW, base_reports, publish, window_and_undated
from caudal.session import shared_dir
from caudal.sources.ledger import Ledger, moves_source
from caudal.sources.sinks import Refresh, read_report
from caudal.sources.tables import ledger_signature, mapped_ledger
from caudal.streaming.refresh import STREAM_REPORTS, extract_at, start_refresh, write_extract

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN"}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1
    assert rows[0].saldo_liquido == 8123135.67  # FIXTURES.md, sf0.001
    assert rows[0].burn_rate == 3062265.09


STREAMS = set(STREAM_REPORTS)
NAMES = sorted(set(catalog.queries()) - STREAMS)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(E.queries()) and set(oracle.oracle_sql()) <= set(E.oracle_sql())


def _agrees(spark, duck, name, df):
    res = duck.execute(oracle.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    duck_types = {d[0]: str(d[1]) for d in res.description}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types
    assert _sorted_rows(df.columns, df.collect()) == _sorted_rows(dcols, res.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    """On the mapping as a plan: nothing is materialised before."""
    _agrees(spark, duck, name, catalog.queries()[name](spark, SF_SMALL))


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_stream_query_matches_oracle(spark, duck, name):
    _agrees(spark, duck, name, catalog.queries()[name](spark, SF_SMALL))


@pytest.fixture(scope="module")
def materialised(spark):
    catalog.materialise(spark, SF_SMALL)


@pytest.mark.parametrize("name", ["kpi_bundle", "aging_report", "payments_source", "client_concentration", "kpi_bundle_v"])
def test_materialised_ledger_gives_the_same(spark, duck, materialised, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    assert "caudal/ledger" in _plan(df)
    _agrees(spark, duck, name, df)


def test_changed_table_is_seen_in_the_same_session(spark, tmp_path):
    for t in ("orders", "customer", "lineitem", "supplier"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    catalog.materialise(spark, str(tmp_path))
    before = catalog.run("moves_source", spark, str(tmp_path)).count()
    half = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    after = catalog.run("moves_source", spark, str(tmp_path)).count()
    bills = catalog.run("moves_source", spark, SF_SMALL).filter("move_type = 'in_invoice'").count()
    assert bills < after < before


def test_unfinished_copy_is_not_read(spark, tmp_path):
    for t in ("orders", "customer", "lineitem", "supplier"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(50).write.parquet(f"{tmp_path}/{t}.parquet")
    p = catalog.PARAMS
    base = f"{shared_dir(spark)}/caudal/ledger/{ledger_signature(spark, str(tmp_path))}"
    moves = mapped_ledger(spark, str(tmp_path), p.as_of).moves
    moves.limit(0).write.parquet(f"{base}/moves")
    spark.createDataFrame([], "signature string").write.parquet(f"{base}/manifest")
    before = catalog.run("moves_source", spark, str(tmp_path)).count()
    catalog.materialise(spark, str(tmp_path))
    after = catalog.run("moves_source", spark, str(tmp_path))
    assert "caudal/ledger" in _plan(after) and after.count() == before > 0


# -- the refresh stream -----------------------------------------------------------------


def _same(spark, work, name, want, day=None):
    got = read_report(spark, f"{work}/reports", name, day or catalog.PARAMS.as_of)
    assert _sorted_rows(got.columns, got.collect()) == \
        _sorted_rows(want.columns, want.select(*got.columns).collect()), name


def _work(spark, what):
    return f"{shared_dir(spark)}/caudal/test-{what}/{uuid.uuid4().hex}"


def _tick(spark, work, extras, **kw):
    q = start_refresh(spark, f"{work}/inbox", work, lambda _: extras, available_now=True, **kw)
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_stream_equals_batch_and_resumes(spark):
    """Two extracts, the job stopped and restarted between: every report equals the batch one."""
    p, work = catalog.PARAMS, _work(spark, "stream")
    raw = mapped_ledger(spark, SF_SMALL, p.as_of)
    batches = []
    for seq, (day, moves) in enumerate(((date(2000, 12, 31), extract_at(raw.moves, date(2000, 12, 31))), (p.as_of, raw.moves)), 1):
        write_extract(moves, f"{work}/inbox", seq, day)
        q = _tick(spark, work, raw, p=p)
        batches.append({x["batchId"] for x in q.recentProgress})
    assert batches == [{0}, {1}]  # the restart went on behind the first extract
    for name in REPORTS:
        if name not in WINDOW + ("monthly_facts",):
            _same(spark, work, name, catalog.run(name, spark, SF_SMALL))
    assert read_report(spark, f"{work}/reports", "aging_report", date(2000, 12, 31)).count() > 0


def test_documents_that_left_the_extract_are_gone(spark, make_moves, journals):
    work = _work(spark, "vanish")
    extras = Ledger(None, spark.createDataFrame([], S.PAYMENTS_SCHEMA), journals)
    both = [move(1, residual="20.00"), move(2, residual="40.00")]
    write_extract(make_moves(both), f"{work}/inbox", 1, AS_OF)
    _tick(spark, work, extras)
    assert sum(r.monto for r in read_report(spark, f"{work}/reports", "aging_report", AS_OF).collect()) == 60.0
    write_extract(make_moves(both[:1]), f"{work}/inbox", 2, AS_OF)
    _tick(spark, work, extras)
    (r,) = read_report(spark, f"{work}/reports", "aging_report", AS_OF).collect()
    assert (r.monto, r.facturas) == (20.0, 1)


def test_stream_takes_the_extracts_date_and_fresh_journals(spark, make_moves, journals):
    work, next_day = _work(spark, "days"), AS_OF + timedelta(days=1)
    payments = spark.createDataFrame([], S.PAYMENTS_SCHEMA)
    for seq, (day, scale) in enumerate(((AS_OF, 1), (next_day, 3))):
        write_extract(make_moves([move(1, residual="20.00", due=AS_OF)]), f"{work}/inbox", seq, day)
        now = journals.withColumn("current_balance", (F.col("current_balance") * scale).cast(S.MONEY))
        _tick(spark, work, Ledger(None, payments, now))
    for day, balance, overdue in ((AS_OF, 1500.0, 0.0), (next_day, 4500.0, 20.0)):
        b = read_report(spark, f"{work}/reports", "kpi_bundle", day).first()
        assert (b.saldo_liquido, b.cxc_vencida) == (balance, overdue)


def test_every_waiting_date_is_published(spark, make_moves, journals):
    """Three extracts wait at the first tick: each date gets its newest one's reports."""
    work, next_day = _work(spark, "waiting"), AS_OF + timedelta(days=1)
    extras = Ledger(None, spark.createDataFrame([], S.PAYMENTS_SCHEMA), journals)
    for seq, (day, residual) in enumerate(((AS_OF, "20.00"), (AS_OF, "30.00"), (next_day, "40.00"))):
        write_extract(make_moves([move(1, residual=residual)]), f"{work}/inbox", seq, day)
    _tick(spark, work, extras)
    for day, total in ((AS_OF, 30.0), (next_day, 40.0)):
        assert sum(r.monto for r in read_report(spark, f"{work}/reports", "aging_report", day).collect()) == total


def test_a_tick_writes_reports_and_sums_only(spark, make_moves, journals):
    """Whatever came in, nothing but the checkpoint, the reports and the state is on disk, and no moves in the state."""
    work = _work(spark, "bytes")
    extras = Ledger(None, spark.createDataFrame([], S.PAYMENTS_SCHEMA), journals)
    write_extract(make_moves([move(1)]), f"{work}/inbox", 1, AS_OF)
    _tick(spark, work, extras)
    assert sorted(os.listdir(work)) == ["checkpoint", "inbox", "reports", "state"]
    assert set(os.listdir(f"{work}/reports")) == {*REPORTS, "critical_candidates", "_published"}
    assert sorted(x for x in os.listdir(f"{work}/state") if not x.startswith(".")) == ["000000000001.json", "facts"]
    (folder,) = os.listdir(f"{work}/state/facts")
    assert spark.read.parquet(f"{work}/state/facts/{folder}").columns == X.SCHEMA.fieldNames()


# -- publish ----------------------------------------------------------------------------


@pytest.mark.parametrize("as_of,top", [(date(2001, 8, 1), 8), (date(2001, 5, 1), 3)])
def test_publish_at_any_date(spark, as_of, top):
    """Every report equals its query at the same date and parameters; a re-run replaces the date."""
    p = replace(catalog.PARAMS, as_of=as_of, top_clients=top)
    out, raw = _work(spark, "publish"), mapped_ledger(spark, SF_SMALL, as_of)
    publish(spark, raw, out, p)
    if top == 3:
        publish(spark, raw, out, p)
    ctx = catalog.Ctx(spark, SF_SMALL, p, raw=raw)
    for name in REPORTS:
        got = read_report(spark, out, name, as_of)
        if name == "staging":
            assert got.count() == ctx.staged.count()
        elif name not in WINDOW + ("monthly_facts",):
            want = catalog.build(name, ctx)
            assert _sorted_rows(got.columns, got.collect()) == _sorted_rows(want.columns, want.select(*got.columns).collect()), name
    assert read_report(spark, out, "client_concentration", as_of).count() <= top + 1


def test_rerun_replaces_a_report_that_became_empty(spark):
    out = _work(spark, "empty")
    for n in (2, 0):
        tables = Refresh(spark, out, AS_OF)
        tables.write("alerts", spark.range(n))
        tables.commit()
        assert read_report(spark, out, "alerts", AS_OF).count() == n


def test_publish_at_another_date_equals_the_oracle(spark, duck):
    p = replace(catalog.PARAMS, as_of=date(2001, 5, 1))
    out = _work(spark, "publish-oracle")
    publish(spark, mapped_ledger(spark, SF_SMALL, p.as_of), out, p)
    for report, key in (("kpi_bundle", "kpi_bundle_at"), ("scenario_grid", "scenario_grid_at")):
        _agrees(spark, duck, key, read_report(spark, out, report, p.as_of))


def test_publish_scans_the_moves_three_times(spark):
    """Once for the staged table, once for the facts; the staged table once for the critical invoices."""
    p = catalog.PARAMS
    raw = mapped_ledger(spark, SF_SMALL, p.as_of)
    out = _work(spark, "scans")
    spark.createDataFrame([], S.MOVES_SCHEMA).write.parquet(f"{out}/moves")
    moves = spark.read.schema(S.MOVES_SCHEMA).parquet(f"{out}/moves")
    staged = stage(moves_source(moves, p.as_of), p.as_of)
    staged.write.parquet(f"{out}/staging")
    facts = X.ledger_facts(window_and_undated(moves, p.as_of, p.lookback_days))
    facts.write.parquet(f"{out}-facts")
    written = spark.read.schema(X.SCHEMA).parquet(f"{out}-facts")
    staged = spark.read.schema(staged.schema).parquet(f"{out}/staging")
    base = base_reports(spark, written, written, staged, raw.payments, raw.journals, p)

    def scans(df):
        return sum(x.startswith("Scan parquet") and f"{out}/" in x for x in re.split(r"\n\(\d+\) ", _plan(df)))

    assert scans(facts) == 1
    assert 1 + scans(facts) + sum(scans(df) for df in base.values()) == 3  # the staged table's own scan first


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["aging_report", "kpi_bundle", "client_concentration",
                                  "collections_velocity", "scenario_grid", "monthly_net_cashflow"])
def test_plan_shape(spark, name):
    plan = _plan(catalog.run(name, spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # every ledger scan is pruned and filtered at the source
    assert "PushedFilters: [" in plan
    import re
    widths = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert widths and max(widths) < 9  # never the whole ledger row
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _tree(plan: str) -> list[tuple[int, str]]:
    lines = plan.split("== Physical Plan ==", 1)[1].strip("\n").split("\n\n", 1)[0].splitlines()
    out = []
    for line in lines:
        m = re.search(r"[A-Za-z]", line)
        if m:
            out.append((m.start(), line[m.start():]))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_windows_only_see_grouped_rows(spark, name):
    """SURVEY §5.5: every window runs above an aggregate (or a bounded top-N,
    or the generated scenario grid), never directly over the ledger scan."""
    tree = _tree(_plan(catalog.queries()[name](spark, SF_SMALL)))
    for i, (depth, op) in enumerate(tree):
        if not op.startswith("Window"):
            continue
        sub = []
        for d, o in tree[i + 1:]:
            if d <= depth:
                break
            sub.append(o)
        below_first_scan = []
        for o in sub:
            if o.startswith("Scan"):
                break
            below_first_scan.append(o)
        assert any(o.startswith(("HashAggregate", "TakeOrderedAndProject", "Range"))
                   for o in below_first_scan), (name, sub)


COVERED = {
    "dso": ["move_type", "amount_residual"], "dso_v": ["move_type", "state", "payment_date"], "dso_doc": ["move_type"],
    "burn_rate": ["move_type", "invoice_date"], "burn_rate_v": ["move_type", "state", "invoice_date"],
    "cash_runway": ["move_type", "invoice_date"], "cash_runway_v": ["move_type", "state", "invoice_date"],
    "liquidity_ratio": ["move_type", "date_maturity", "amount_residual"],
    "liquidity_ratio_v": ["move_type", "state", "date_maturity", "amount_residual"],
    "liquidity_ratio_doc": ["move_type", "invoice_date"], "collection_rate": ["move_type"],
    "collection_rate_doc": ["move_type", "invoice_date"], "grand_totals": ["move_type", "amount_residual", "date_maturity"],
    "whatif_runway": ["move_type", "invoice_date"], "projected_cash_doc": ["move_type", "invoice_date"],
    "critical_invoices": ["move_type", "date_maturity", "amount_residual"],
    "critical_invoices_display": ["move_type", "date_maturity", "amount_residual"],
    "critical_badge": ["move_type", "date_maturity", "amount_residual"],
    "overdue_aging_v": ["move_type", "date_maturity", "amount_residual"],
}


@pytest.mark.parametrize("name", sorted(COVERED))
def test_filters_reach_the_scan(spark, materialised, name):
    """Some scan of the ledger has all of the query's conditions on values; type and period prune folders."""
    plan = _plan(catalog.run(name, spark, SF_SMALL))
    scans = [x for x in re.split(r"\n\(\d+\) ", plan) if x.startswith("Scan parquet") and "caudal/ledger" in x and "/moves" in x]
    assert scans
    best = 0
    for scan in scans:
        part, pushed = (re.search(rf"{k}: \[(.*)\]", scan) for k in ("PartitionFilters", "PushedFilters"))
        said = (part[1] if part else "") + (pushed[1] if pushed else "")
        conditions = [c for c in said.replace("isnotnull", "IsNotNull").split(", ") if not c.strip().startswith("IsNotNull")] + (
            ["payment_date"] if "IsNotNull(payment_date)" in said else []) + (
            ["date_maturity"] if name == "grand_totals" and "IsNotNull(date_maturity)" in said else [])
        cut = "\n".join(conditions)
        narrowed = "invoice_date" not in COVERED[name] or "2001-05-03" in said  # the burn and 90-day cutoff, not the look-back
        best = max(best, narrowed and sum(c in cut for c in COVERED[name]))
    assert best == len(COVERED[name]), scans


def test_command_line_jobs(spark):
    """Both production entry points, end to end, on a ledger written to disk."""
    from caudal.plans import publish as publish_job
    from caudal.streaming import refresh
    p, work = catalog.PARAMS, _work(spark, "cli")
    raw = mapped_ledger(spark, SF_SMALL, p.as_of)
    raw.moves.select(*S.MOVES_SCHEMA.fieldNames()).write.parquet(f"{work}/ledger/moves")
    raw.payments.write.parquet(f"{work}/ledger/payments")
    raw.journals.write.parquet(f"{work}/ledger/journals")
    publish_job.main(["--ledger", f"{work}/ledger", "--out", f"{work}/reports", "--as-of", p.as_of.isoformat()])
    _same(spark, work, "kpi_bundle", catalog.run("kpi_bundle", spark, SF_SMALL))
    write_extract(raw.moves, f"{work}/inbox", 1, p.as_of)
    refresh.main(["--inbox", f"{work}/inbox", "--ledger", f"{work}/ledger", "--workdir", f"{work}/stream", "--once"])
    _same(spark, f"{work}/stream", "aging_report", catalog.run("aging_report", spark, SF_SMALL))
