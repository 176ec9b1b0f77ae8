"""The whole pipeline on skewed input tables, checked against the oracle SQL.

One customer places a third of all orders and one supplier ships a third of
all line items: the mapping's joins and aggregates (orders x customer, the
per-bill aggregate x supplier, the per-customer balances) must give exactly
what DuckDB computes from the same files.
"""

from __future__ import annotations

import math
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledger_rows import SF_SMALL

import __spark_entry__ as E
from caudal.sources import tables

QUERIES = ("moves_source", "journals_source", "aging_report", "kpi_bundle", "client_concentration",
           "scenario_grid", "monthly_net_cashflow", "kpi_bundle_v")


@pytest.fixture(scope="module")
def skewed_dir():
    rng = np.random.default_rng(7)
    d = tempfile.mkdtemp(prefix="caudal-skew-")
    n_orders, n_cust, n_items, n_supp = 3000, 200, 6000, 50
    days = pd.to_datetime("1999-06-01") + pd.to_timedelta(rng.integers(0, 800, n_orders), unit="D")
    pd.DataFrame({
        "o_orderkey": np.arange(1, n_orders + 1, dtype="int64"),
        "o_custkey": np.where(np.arange(n_orders) % 3 == 0, 1, rng.integers(2, n_cust + 1, n_orders)).astype("int64"),
        "o_orderstatus": rng.choice(["F", "O", "P"], n_orders),
        "o_totalprice": np.round(rng.uniform(100, 50000, n_orders), 2),
        "o_orderdate": days.astype("datetime64[us]"),
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], n_orders),
    }).to_parquet(f"{d}/orders.parquet")
    pd.DataFrame({
        "c_custkey": np.arange(1, n_cust + 1, dtype="int64"),
        "c_name": [f"Customer#{i:09d}" for i in range(1, n_cust + 1)],
        "c_mktsegment": rng.choice(["BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"], n_cust),
    }).to_parquet(f"{d}/customer.parquet")
    ship = pd.to_datetime("1999-06-01") + pd.to_timedelta(rng.integers(0, 800, n_items), unit="D")
    pd.DataFrame({
        "l_suppkey": np.where(np.arange(n_items) % 3 == 0, 1, rng.integers(2, n_supp + 1, n_items)).astype("int64"),
        "l_extendedprice": np.round(rng.uniform(10, 9000, n_items), 2),
        "l_discount": np.round(rng.choice([0.0, 0.01, 0.05, 0.1], n_items), 2),
        "l_linestatus": rng.choice(["F", "O"], n_items),
        "l_shipdate": ship.astype("datetime64[us]"),
    }).to_parquet(f"{d}/lineitem.parquet")
    pd.DataFrame({
        "s_suppkey": np.arange(1, n_supp + 1, dtype="int64"),
        "s_name": [f"Supplier#{i:09d}" for i in range(1, n_supp + 1)],
    }).to_parquet(f"{d}/supplier.parquet")
    return d


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v.isoformat()[:10] if hasattr(v, "isoformat") else v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_tables_match_oracle(spark, skewed_dir, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    df = E.queries()[name](spark, skewed_dir)
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert _rows(df.columns, df.collect()) == _rows(dcols, res.fetchall())


def test_large_tables_are_dealt_by_their_size(spark, monkeypatch):
    """Bills of a table above a task's share per core are made by as many tasks as it has shares, and are the same."""
    want = tables.map_moves(spark, SF_SMALL)
    monkeypatch.setattr(tables, "TASK_BYTES", tables.input_bytes(spark, f"{SF_SMALL}/lineitem.parquet") // 8)
    got = tables.map_moves(spark, SF_SMALL).filter("move_type = 'in_invoice'")
    assert got.rdd.getNumPartitions() == 9  # nine shares, and no task of the orders
    assert sorted(map(str, got.collect())) == sorted(map(str, want.filter("move_type = 'in_invoice'").collect()))
