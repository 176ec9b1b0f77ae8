"""DuckDB oracle: for every registered query, the same result in plain SQL.

The oracle only sees the driver's raw tables, so every statement starts with
the ledger mapping (``moves_raw``, ``payments_raw``, ``journals_raw``) and
the staging rules, written independently of the DataFrame code. Rules kept
identical on both sides: decimal sums, doubles only on output, half-even
rounding, counts as BIGINT, ``/`` guarded against zero.
"""

from __future__ import annotations

from datetime import date, timedelta

from caudal import schema as S

# The dates the registered queries run at (fixed independently of the engine's registry).
PARAMS = S.Params(as_of=date(2001, 8, 1))
EARLIER = S.Params(as_of=date(2001, 5, 1))
NO_MOVES = S.Params(as_of=date(2030, 1, 1))


def _d(d: date) -> str:
    return f"DATE '{d.isoformat()}'"


def money(x: str, scale: int = 2) -> str:
    return f"round_even(CAST({x} AS DOUBLE), {scale})"


def share(part: str, total: str) -> str:
    return f"round_even(CAST({part} AS DOUBLE) / NULLIF(CAST({total} AS DOUBLE), 0) * 100, 1)"


def _labels(values: tuple[str, ...]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def _prefix(p: S.Params) -> str:
    as_of = p.as_of
    cut = as_of - timedelta(days=p.lookback_days)
    end = as_of + timedelta(days=p.horizon_days)
    burn_cut = as_of - timedelta(days=30 * p.burn_months)
    a = _labels(S.AGING_LABELS)
    days = "days_overdue"
    return f"""
moves_raw AS (
  SELECT o_orderkey AS id,
    concat('INV/', cast(year(o_orderdate) AS string), '/', lpad(cast(o_orderkey AS string), 7, '0')) AS name,
    'out_invoice' AS move_type,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'draft' ELSE 'posted' END AS state,
    cast(o_orderdate AS date) AS invoice_date,
    cast(o_orderdate AS date) + cast(CASE WHEN o_orderpriority = '1-URGENT' THEN 30 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 45 ELSE 60 END AS int) AS date_maturity,
    cast(o_totalprice AS decimal(18,2)) AS amount_total,
    CASE o_orderstatus WHEN 'F' THEN cast(0 AS decimal(18,2)) WHEN 'O' THEN cast(o_totalprice AS decimal(18,2)) ELSE cast(cast(o_totalprice AS decimal(18,2)) * cast(0.50 AS decimal(3,2)) AS decimal(18,2)) END AS amount_residual,
    coalesce(c_name, 'Sin partner') AS partner_name,
    CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + cast(5 + o_orderkey % 60 AS int) END AS payment_date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT (l_suppkey * 100000000 + year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) * 10 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END,
    concat('BILL/', cast(year(l_shipdate) AS string), '/', lpad(cast(l_suppkey AS string), 7, '0'), '/', l_linestatus),
    'in_invoice', 'posted', cast(l_shipdate AS date), cast(l_shipdate AS date) + 30,
    cast(sum(cast(cast(l_extendedprice AS decimal(12,2)) * (cast(1 AS decimal(4,2)) - cast(l_discount AS decimal(4,2))) AS decimal(18,2))) AS decimal(18,2)),
    CASE WHEN l_linestatus = 'F' THEN cast(0 AS decimal(18,2)) ELSE cast(cast(sum(cast(cast(l_extendedprice AS decimal(12,2)) * (cast(1 AS decimal(4,2)) - cast(l_discount AS decimal(4,2))) AS decimal(18,2))) AS decimal(18,2)) * cast(0.40 AS decimal(3,2)) AS decimal(18,2)) END,
    coalesce(s_name, 'Sin partner'),
    CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS date) + 20 END
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_suppkey, s_name, l_shipdate, l_linestatus
),
payments_raw AS (
  SELECT id, payment_date AS date, amount_total AS amount,
    CASE WHEN move_type = 'out_invoice' THEN 'inbound' ELSE 'outbound' END AS payment_type,
    'posted' AS state, partner_name
  FROM moves_raw WHERE payment_date IS NOT NULL
),
journals_raw AS (
  SELECT CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'AUTOMOBILE' THEN 4 ELSE 5 END AS BIGINT) AS id,
    c_mktsegment AS name,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'bank' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'cash' ELSE 'general' END AS type,
    cast(sum(cast(o_totalprice AS decimal(18,2))) AS decimal(18,2)) AS current_balance
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus = 'F' AND cast(o_orderdate AS date) BETWEEN {_d(as_of - timedelta(days=365))} AND {_d(as_of)}
  GROUP BY c_mktsegment
),
moves AS (
  SELECT id, name, move_type, state, invoice_date, date_maturity, amount_total, amount_residual, partner_name
  FROM moves_raw
  WHERE move_type IN ('out_invoice', 'in_invoice') AND state = 'posted' AND invoice_date >= {_d(cut)}
),
payments AS (
  SELECT id, date, amount, payment_type, state, partner_name, 'desconocido' AS journal_tipo
  FROM payments_raw
  WHERE state = 'posted' AND date >= {_d(cut)} AND payment_type IN ('inbound', 'outbound')
),
journals AS (
  SELECT id, name, type, coalesce(current_balance, CAST(0 AS DECIMAL(18,2))) AS current_balance
  FROM journals_raw WHERE type IN ('bank', 'cash')
),
staging0 AS (
  SELECT *,
    CAST(CASE WHEN date_maturity IS NOT NULL THEN greatest(date_diff('day', date_maturity, {_d(as_of)}), 0) END AS INTEGER) AS days_overdue,
    CASE WHEN date_maturity IS NOT NULL THEN greatest(date_diff('day', invoice_date, date_maturity), 0) END AS dias,
    CASE WHEN amount_residual = 0 THEN amount_total ELSE CAST(0 AS DECIMAL(18,2)) END AS collected_amt
  FROM moves WHERE invoice_date IS NOT NULL
),
staging AS (
  SELECT id, name, move_type, state, invoice_date, date_maturity, amount_total, amount_residual, partner_name,
    CAST(year(invoice_date) AS INTEGER) AS year,
    strftime(invoice_date, '%Y-%m') AS month,
    CAST(year(invoice_date) AS VARCHAR) || 'Q' || CAST(quarter(invoice_date) AS VARCHAR) AS quarter,
    CAST(weekofyear(invoice_date) AS INTEGER) AS week_num,
    amount_residual = 0 AS is_collected,
    coalesce(date_maturity < {_d(as_of)} AND amount_residual > 0, false) AS is_overdue,
    days_overdue,
    collected_amt,
    CAST(amount_total - collected_amt AS DECIMAL(18,2)) AS pending_amt,
    CASE WHEN {days} = 0 THEN 'Al corriente' WHEN {days} <= 30 THEN 'Riesgo bajo'
         WHEN {days} <= 60 THEN 'Riesgo medio' WHEN {days} > 60 THEN 'Riesgo crítico'
         ELSE 'Sin vencimiento' END AS nivel_riesgo,
    CASE WHEN {days} <= 0 THEN {a[0]} WHEN {days} <= 30 THEN {a[1]} WHEN {days} <= 60 THEN {a[2]}
         WHEN {days} <= 90 THEN {a[3]} WHEN {days} > 90 THEN {a[4]} END AS tramo_aging,
    CAST(CASE WHEN {days} <= 0 THEN 0 WHEN {days} <= 30 THEN 1 WHEN {days} <= 60 THEN 2
         WHEN {days} <= 90 THEN 3 WHEN {days} > 90 THEN 4 END AS INTEGER) AS tramo_orden,
    dias
  FROM staging0
),
moves_v AS (
  SELECT * FROM moves_raw WHERE invoice_date >= {_d(cut)}
),
staging_v AS (
  SELECT id, name, move_type, state, invoice_date, date_maturity, amount_total, amount_residual, partner_name, payment_date,
    CAST(year(invoice_date) AS INTEGER) AS year,
    strftime(invoice_date, '%Y-%m') AS month,
    strftime(CAST(date_trunc('week', invoice_date) AS DATE), '%Y-%m-%d') || '/' ||
      strftime(CAST(date_trunc('week', invoice_date) AS DATE) + 6, '%Y-%m-%d') AS week,
    amount_residual = 0 AS is_collected,
    coalesce(date_maturity < {_d(as_of)} AND amount_residual > 0, false) AS is_overdue,
    CAST(CASE WHEN date_maturity IS NOT NULL THEN greatest(date_diff('day', date_maturity, {_d(as_of)}), 0) END AS INTEGER) AS days_overdue,
    CASE WHEN amount_residual = 0 THEN amount_total ELSE CAST(0 AS DECIMAL(18,2)) END AS collected_amt
  FROM moves_v WHERE invoice_date IS NOT NULL
),
stats AS (
  SELECT count(*) AS n_moves,
    avg(CASE WHEN move_type = 'out_invoice' AND is_collected THEN dias END) AS dso_raw,
    coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN amount_total END), 0) AS billed_out,
    coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN collected_amt END), 0) AS collected_out,
    coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN amount_residual END), 0) AS residual_out,
    coalesce(sum(CASE WHEN move_type = 'in_invoice' AND is_overdue THEN amount_residual END), 0) AS overdue_in,
    coalesce(sum(CASE WHEN is_overdue THEN amount_residual END), 0) AS overdue_all,
    CAST(coalesce(sum(CASE WHEN is_overdue AND days_overdue > 60 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_critical
  FROM staging
),
burn_m AS (
  SELECT month, sum(amount_total) AS s FROM staging
  WHERE move_type = 'in_invoice' AND invoice_date >= {_d(burn_cut)} GROUP BY month
),
burn AS (
  SELECT coalesce(round_even(CAST(sum(s) AS DOUBLE) / count(*), 2), 0.0) AS burn_rate FROM burn_m
),
bal AS (
  SELECT coalesce(sum(current_balance), CAST(0 AS DECIMAL(18,2))) AS saldo FROM journals WHERE type IN ('bank', 'cash')
),
burn_v_m AS (
  SELECT strftime(invoice_date, '%Y-%m') AS month, sum(amount_total) AS s FROM moves_v
  WHERE move_type = 'in_invoice' AND state = 'posted' AND invoice_date >= {_d(burn_cut)} GROUP BY 1
),
burn_v AS (
  SELECT round_even(CAST(sum(s) AS DOUBLE) / count(*), 2) AS burn_rate FROM burn_v_m
),
bal_v AS (
  SELECT coalesce(sum(current_balance), CAST(0 AS DECIMAL(18,2))) AS saldo FROM journals_raw WHERE type IN ('bank', 'cash')
),
cash_all AS (
  SELECT coalesce(sum(current_balance), CAST(0 AS DECIMAL(18,2))) AS liquido FROM journals_raw
),
dso_v AS (
  SELECT round_even(avg(date_diff('day', invoice_date, payment_date)), 1) AS dso FROM moves_v
  WHERE move_type = 'out_invoice' AND state = 'posted' AND payment_date IS NOT NULL
),
liq_v AS (
  SELECT CASE WHEN p.pasivos = 0 THEN 99.99
    ELSE round_even(CAST((SELECT liquido FROM cash_all) AS DOUBLE) / CAST(p.pasivos AS DOUBLE), 2) END AS liquidity_ratio
  FROM (SELECT coalesce(sum(amount_residual), 0) AS pasivos FROM moves_v
    WHERE move_type = 'in_invoice' AND state = 'posted' AND date_maturity < {_d(as_of)} AND amount_residual > 0) p
),
exp_v AS (
  SELECT {money("coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN amount_residual END), 0)")} AS total_ar,
    {money("coalesce(sum(CASE WHEN is_overdue THEN amount_residual END), 0)")} AS overdue_ar
  FROM staging_v
),
bundle_v AS (
  SELECT (SELECT dso FROM dso_v) AS dso, b.burn_rate,
    CASE WHEN b.burn_rate <= 0 THEN CAST('inf' AS DOUBLE)
      ELSE round_even(CAST((SELECT saldo FROM bal_v) AS DOUBLE) / b.burn_rate, 1) END AS cash_runway,
    (SELECT liquidity_ratio FROM liq_v) AS liquidity_ratio,
    (SELECT {money("liquido")} FROM cash_all) AS total_cash,
    (SELECT total_ar FROM exp_v) AS total_ar, (SELECT overdue_ar FROM exp_v) AS overdue_ar
  FROM burn_v b
),
bundle AS (
  SELECT coalesce(round_even(s.dso_raw, 1), 0.0) AS dso,
    s.burn_rate,
    CASE WHEN s.burn_rate <= 0 THEN CAST('inf' AS DOUBLE) ELSE round_even(CAST(s.saldo AS DOUBLE) / s.burn_rate, 1) END AS cash_runway,
    {money("s.saldo")} AS saldo_liquido,
    CASE WHEN s.n_moves = 0 THEN 0.0 WHEN s.overdue_in = 0 THEN 99.0
         ELSE round_even(CAST(s.saldo AS DOUBLE) / CAST(s.overdue_in AS DOUBLE), 2) END AS liquidity_ratio,
    coalesce({share("s.collected_out", "s.billed_out")}, 0.0) AS collection_rate,
    {money("s.residual_out")} AS total_cxc,
    {money("s.overdue_all")} AS cxc_vencida,
    s.n_critical AS n_criticas
  FROM (SELECT *, (SELECT burn_rate FROM burn) AS burn_rate, (SELECT saldo FROM bal) AS saldo FROM stats) s
),
bundle_c AS (
  SELECT *,
    CASE WHEN dso > 60 THEN 'danger' WHEN dso > 45 THEN 'warning' ELSE 'success' END AS color_dso,
    CASE WHEN cash_runway < 3 THEN 'danger' WHEN cash_runway < 6 THEN 'warning' ELSE 'success' END AS color_runway,
    CASE WHEN liquidity_ratio < 1.0 THEN 'danger' WHEN liquidity_ratio < 1.5 THEN 'warning' ELSE 'success' END AS color_liq,
    CASE WHEN collection_rate > 80 THEN 'success' WHEN collection_rate > 60 THEN 'warning' ELSE 'danger' END AS color_tasa
  FROM bundle
),
daily AS (
  SELECT date_maturity AS fecha,
    sum(CASE WHEN move_type = 'out_invoice' THEN amount_residual END) AS base_in,
    sum(CASE WHEN move_type = 'in_invoice' THEN amount_residual END) AS base_out
  FROM staging
  WHERE amount_residual > 0 AND move_type IN ('out_invoice', 'in_invoice')
    AND date_maturity BETWEEN {_d(as_of)} AND {_d(end)}
  GROUP BY 1
),
daily_v AS (
  SELECT date_maturity AS fecha,
    sum(CASE WHEN move_type = 'out_invoice' THEN amount_residual END) AS base_in,
    sum(CASE WHEN move_type = 'in_invoice' THEN amount_residual END) AS base_out
  FROM staging_v
  WHERE amount_residual > 0 AND move_type IN ('out_invoice', 'in_invoice') AND state = 'posted'
    AND date_maturity BETWEEN {_d(as_of)} AND {_d(end)}
  GROUP BY 1
)
"""


def _factors(pct: str) -> str:
    c = f"CAST(CAST(CAST({pct} AS DECIMAL(5,0)) / 100 AS DECIMAL(10,6)) AS DECIMAL(6,4))"
    return (f"{c} AS c, "
            f"CAST(least({c} * CAST(1.15 AS DECIMAL(3,2)), CAST(1 AS DECIMAL(6,4))) AS DECIMAL(6,4)) AS c_opt, "
            f"CAST(greatest({c} * CAST(0.85 AS DECIMAL(3,2)), CAST(0 AS DECIMAL(6,4))) AS DECIMAL(6,4)) AS c_pes")


def _scenarios(lo: int, hi: int, step: int) -> str:
    return f"""scen AS (
  SELECT CAST(i AS INTEGER) AS pct, {_factors('i')} FROM range({lo}, {hi}, {step}) t(i)
)"""


def _grid_rows(lo: int, hi: int, step: int, days: int, name: str, as_of: date) -> str:
    """Scenario x day rows from one range: row i is scenario i // days on day i % days."""
    n = len(range(lo, hi, step))
    return (f"SELECT CAST({lo} + (i // {days}) * {step} AS INTEGER) AS {name}, "
            f"CAST({_d(as_of)} + CAST(i % {days} AS INTEGER) AS DATE) AS fecha FROM range({n * days}) t(i)")


def _grid(lo: int, hi: int, step: int, days: int = 90, as_of: date = PARAMS.as_of) -> str:
    run = "OVER (PARTITION BY pct ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""grid AS (
  SELECT g.pct, g.fecha, {_factors('g.pct')}, (SELECT saldo FROM bal) AS opening,
    coalesce(d.base_in, CAST(0 AS DECIMAL(18,2))) AS bi,
    coalesce(d.base_out, CAST(0 AS DECIMAL(18,2))) AS bo
  FROM ({_grid_rows(lo, hi, step, days, 'pct', as_of)}) g LEFT JOIN daily d ON d.fecha = g.fecha
  WHERE EXISTS (SELECT 1 FROM staging)
),
proj AS (
  SELECT pct, fecha, bi * c AS ingreso, bo AS egreso,
    opening + sum(bi * c - bo) {run} AS saldo,
    opening + sum(bi * c_opt - bo) {run} AS saldo_opt,
    opening + sum(bi * c_pes - bo) {run} AS saldo_pes
  FROM grid
)"""


def _proj_cols() -> str:
    return (f"fecha, {money('ingreso', 6)} AS ingreso, {money('egreso')} AS egreso, "
            f"{money('saldo', 6)} AS saldo, {money('saldo_opt', 6)} AS saldo_opt, "
            f"{money('saldo_pes', 6)} AS saldo_pes")


def _grid_v(lo: int, hi: int, step: int, days: int = 90) -> str:
    run = "OVER (PARTITION BY impayment_pct ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    keep = "CAST(1 - CAST(CAST(CAST(g.impayment_pct AS DECIMAL(5,0)) / 100 AS DECIMAL(10,6)) AS DECIMAL(6,4)) AS DECIMAL(6,4))"
    return f"""grid_v AS (
  SELECT g.impayment_pct, g.fecha, (SELECT liquido FROM cash_all) AS opening,
    coalesce(d.base_in, CAST(0 AS DECIMAL(18,2))) * {keep} AS inflow,
    coalesce(d.base_out, CAST(0 AS DECIMAL(18,2))) AS outflow
  FROM ({_grid_rows(lo, hi, step, days, 'impayment_pct', PARAMS.as_of)}) g LEFT JOIN daily_v d ON d.fecha = g.fecha
),
proj_v AS (
  SELECT impayment_pct, fecha AS date, inflow, outflow, opening + sum(inflow - outflow) {run} AS balance FROM grid_v
)"""


_PROJ_V_COLS = (f"date, {money('inflow', 6)} AS inflow, {money('outflow')} AS outflow, "
                f"{money('balance', 6)} AS balance")


def _money_text(x: str) -> str:
    return f"'$' || format('{{:,.0f}}', CAST({x} AS DOUBLE))"


_STAGING_COLS = (
    "id, name, move_type, state, invoice_date, date_maturity, "
    f"{money('amount_total')} AS amount_total, {money('amount_residual')} AS amount_residual, partner_name, "
    "year, month, quarter, week_num, is_collected, is_overdue, days_overdue, "
    f"{money('collected_amt')} AS collected_amt, {money('pending_amt')} AS pending_amt, "
    "nivel_riesgo, tramo_aging, tramo_orden")


def _monthly(src: str, n: int, names: tuple[str, str, str, str], fill: bool) -> str:
    f, c, cnt, rate = names
    rate_expr = share("c", "f")
    if fill:
        rate_expr = f"coalesce({rate_expr}, 0.0)"
    return f"""m AS (
  SELECT month, sum(amount_total) AS f, sum(collected_amt) AS c, count(id) AS n FROM {src}
  WHERE move_type = 'out_invoice' GROUP BY month ORDER BY month DESC LIMIT {n}
)
SELECT month, {money('f')} AS {f}, {money('c')} AS {c}, CAST(n AS BIGINT) AS "{cnt}",
  {rate_expr} AS {rate}, CAST(month || '-01' AS DATE) AS month_dt FROM m"""


def _net(n: int) -> str:
    return f"""g AS (
  SELECT month,
    coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN collected_amt END), 0) AS i,
    coalesce(sum(CASE WHEN move_type = 'in_invoice' THEN amount_total END), 0) AS e
  FROM staging WHERE move_type IN ('out_invoice', 'in_invoice')
  GROUP BY month ORDER BY month DESC LIMIT {n}
),
shown AS (
  SELECT month, i, e, i - e AS n, CAST(month || '-01' AS DATE) AS month_dt, 'relative' AS tipo FROM g
),
net AS (
  SELECT month, {money('i')} AS ingresos, {money('e')} AS egresos, {money('n')} AS neto, month_dt, tipo FROM shown
  UNION ALL
  SELECT 'Total', {money('sum(i)')}, {money('sum(e)')}, {money('sum(n)')},
    CAST(max(month_dt) + INTERVAL 1 MONTH AS DATE), 'total' FROM shown HAVING count(*) > 0
)"""


def _critical(n: int) -> str:
    return f"""crit AS (
  SELECT name, partner_name, strftime(invoice_date, '%d/%m/%Y') AS invoice_date,
    strftime(date_maturity, '%d/%m/%Y') AS date_maturity,
    {money('amount_total')} AS amount_total, {money('amount_residual')} AS amount_residual,
    days_overdue, nivel_riesgo
  FROM staging WHERE move_type = 'out_invoice' AND is_overdue
  ORDER BY staging.amount_residual DESC, name, id LIMIT {n}
)"""


def _aging(src: str = "staging") -> str:
    return f"""g AS (
  SELECT tramo_orden, tramo_aging, sum(amount_residual) AS m, count(id) AS facturas FROM {src}
  WHERE move_type = 'out_invoice' AND amount_residual > 0 AND tramo_orden IS NOT NULL
  GROUP BY tramo_orden, tramo_aging
)
SELECT tramo_aging AS tramo, {money('m')} AS monto, CAST(facturas AS BIGINT) AS facturas,
  CASE WHEN sum(m) OVER () > 0 THEN round_even(CAST(m AS DOUBLE) / CAST(sum(m) OVER () AS DOUBLE) * 100, 1)
       ELSE 0.0 END AS porcentaje
FROM g"""


def _with(*ctes: str, p: S.Params = PARAMS) -> str:
    return "WITH " + ",\n".join([_prefix(p).strip()] + [c.strip() for c in ctes])


def oracle_sql() -> dict[str, str]:
    p = PARAMS
    o = _labels(S.OVERDUE_LABELS)
    days = "days_overdue"
    grid = (range(0, 101, 5), range(0, 51, 5))
    q: dict[str, str] = {}

    q["moves_source"] = _with() + f"""
SELECT id, name, move_type, state, invoice_date, date_maturity, {money('amount_total')} AS amount_total,
  {money('amount_residual')} AS amount_residual, partner_name FROM moves"""
    q["payments_source"] = _with() + f"""
SELECT id, date, {money('amount')} AS amount, payment_type, state, partner_name, journal_tipo FROM payments"""
    q["journals_source"] = _with() + f"""
SELECT id, name, type, {money('current_balance')} AS current_balance FROM journals"""
    # What the irregular text of the export must be read as.
    named = "CASE WHEN id % 7 = 0 OR id % 13 = 0 THEN 'Sin partner' ELSE partner_name END"
    due = "CASE WHEN id % 11 = 0 THEN NULL ELSE date_maturity END"
    moves_cols = (f"id, name, move_type, state, invoice_date, {{due}} AS date_maturity, {money('amount_total')} AS amount_total, "
                  f"{money('amount_residual')} AS amount_residual, {{partner}} AS partner_name, {{paid}} AS payment_date")
    plain = moves_cols.format(due="date_maturity", partner="partner_name", paid="payment_date")
    q["many2one_partner"] = _with() + f"\nSELECT id, {named} AS partner_name FROM moves_raw"
    q["lenient_dates"] = _with() + f"\nSELECT id, invoice_date, {due} AS date_maturity, payment_date FROM moves_raw"
    q["lenient_balances"] = _with() + f"""
SELECT id, name, type, CASE WHEN id % 2 = 0 THEN 0.0 ELSE {money('current_balance')} END AS current_balance FROM journals_raw"""
    q["journal_decode"] = _with() + f"""
SELECT id, date, {money('amount')} AS amount, payment_type, state, partner_name,
  CASE WHEN id % 4 = 0 OR id % 9 = 0 THEN 'desconocido' ELSE 'Banco ' || CAST(id % 3 AS VARCHAR) END AS journal_tipo
FROM payments WHERE id % 10 <> 3"""
    q["load_json"] = _with() + f"\nSELECT {plain} FROM moves_raw"
    q["load_csv"] = _with() + "\nSELECT " + moves_cols.format(
        due="date_maturity", partner="partner_name", paid="CAST(NULL AS DATE)") + " FROM moves_raw"
    q["load_erp"] = _with() + f"\nSELECT {moves_cols.format(due=due, partner=named, paid='payment_date')} FROM moves_raw"
    q["load_parquet"] = q["moves_source"]
    paid_cols = f"id, {{day}} AS date, {money('amount')} AS amount, payment_type, state, partner_name, {{journal}} AS journal_tipo"
    erp_journal = "CASE WHEN id % 4 = 0 OR id % 9 = 0 THEN 'desconocido' ELSE 'Banco ' || CAST(id % 3 AS VARCHAR) END"
    erp_day = "CASE WHEN id % 10 <> 3 THEN date END"
    balances = f"\nSELECT id, name, type, {money('current_balance')} AS current_balance FROM journals_raw"
    for fmt in ("csv", "json", "parquet"):
        q[f"load_payments_{fmt}"] = _with() + "\nSELECT " + paid_cols.format(
            day="date", journal="CAST(NULL AS VARCHAR)") + " FROM payments_raw"
        q[f"load_journals_{fmt}"] = _with() + balances
    q["load_payments_erp"] = _with() + f"\nSELECT {paid_cols.format(day=erp_day, journal=erp_journal)} FROM payments_raw"
    q["load_journals_erp"] = q["lenient_balances"]
    # The faulty export: what is wrong with which row.
    bad_move = ("CASE WHEN id % 29 = 6 THEN 'malformed' WHEN id % 23 = 5 THEN 'missing id' "
                "WHEN id % 19 = 4 THEN 'unreadable amount_total' END")
    bad_payment = "CASE WHEN id % 37 = 8 THEN 'unreadable id' WHEN id % 31 = 7 THEN 'unreadable amount' END"
    q["load_rejects"] = _with() + f"""
SELECT 'moves' AS table_name, {bad_move} AS reason, CASE WHEN id % 29 <> 6 AND id % 23 <> 5 THEN CAST(id AS VARCHAR) END AS id
FROM moves_raw WHERE {bad_move} IS NOT NULL
UNION ALL
SELECT 'payments', {bad_payment}, CASE WHEN id % 37 = 8 THEN 'P-' ELSE '' END || CAST(id AS VARCHAR)
FROM payments_raw WHERE {bad_payment} IS NOT NULL
UNION ALL
SELECT 'journals', 'unreadable id', 'four' FROM journals_raw WHERE id = 4"""
    q["load_accepted"] = q["load_erp"] + f" WHERE {bad_move} IS NULL"
    q["load_accepted_payments"] = q["load_payments_erp"] + f" WHERE {bad_payment} IS NULL"
    q["undated_payments"] = _with() + """
SELECT payment_type, CAST(count(*) AS BIGINT) AS n_undated FROM payments_raw WHERE date IS NULL GROUP BY payment_type"""
    q["undated_payments_erp"] = _with() + """
SELECT payment_type, CAST(count(*) AS BIGINT) AS n_undated FROM payments_raw WHERE id % 10 = 3 GROUP BY payment_type"""
    q["load_pages"] = q["load_erp"]
    q["load_pages_since"] = _with() + f"""
SELECT id, name, move_type, state, invoice_date, {due} AS date_maturity, {money('amount_total')} AS amount_total,
  {money('amount_residual')} AS amount_residual, {named} AS partner_name FROM moves"""
    q["partner_lookup"] = """
SELECT o_orderkey AS id, coalesce(c_name, 'Sin partner') AS partner_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
    q["undated_documents"] = _with() + """
SELECT move_type, CAST(count(*) AS BIGINT) AS n_undated FROM moves_raw WHERE invoice_date IS NULL GROUP BY move_type"""

    q["staging"] = _with() + f"\nSELECT {_STAGING_COLS} FROM staging"
    q["staging_v"] = _with() + f"""
SELECT id, name, move_type, state, invoice_date, date_maturity, {money('amount_total')} AS amount_total,
  {money('amount_residual')} AS amount_residual, partner_name, payment_date, year, month, week,
  is_collected, is_overdue, days_overdue, {money('collected_amt')} AS collected_amt FROM staging_v"""
    q["risk_levels"] = _with() + "\nSELECT id, move_type, days_overdue, nivel_riesgo FROM staging"
    q["date_range"] = _with() + f"""
SELECT {_STAGING_COLS} FROM staging WHERE invoice_date BETWEEN DATE '2001-05-01' AND DATE '2001-07-31'"""

    q["dso"] = _with() + "\nSELECT coalesce(round_even(dso_raw, 1), 0.0) AS dso FROM stats"
    q["dso_v"] = _with() + "\nSELECT dso FROM dso_v"
    q["dso_doc"] = _with() + f"""
SELECT coalesce(round_even(CAST(residual_out AS DOUBLE) / NULLIF(CAST(billed_out AS DOUBLE) * CAST({365.0 / p.lookback_days!r} AS DOUBLE), 0) * 365, 1), 0.0) AS dso
FROM stats"""
    q["burn_rate"] = _with() + "\nSELECT burn_rate FROM burn"
    q["burn_rate_v"] = _with() + "\nSELECT burn_rate FROM burn_v"
    burn_doc_cut = p.as_of - timedelta(days=30 * p.burn_months)
    q["burn_rate_doc"] = _with(f"""pm AS (
  SELECT strftime(date, '%Y-%m') AS month, sum(amount) AS s FROM payments
  WHERE payment_type = 'outbound' AND date >= {_d(burn_doc_cut)} GROUP BY 1
)""") + "\nSELECT coalesce(round_even(CAST(sum(s) AS DOUBLE) / count(*), 2), 0.0) AS burn_rate FROM pm"
    q["liquid_balance"] = _with() + f"\nSELECT {money('saldo')} AS saldo FROM bal"
    q["total_cash_v"] = _with() + f"\nSELECT {money('liquido')} AS total_cash FROM cash_all"
    q["cash_runway"] = _with() + "\nSELECT cash_runway FROM bundle"
    q["cash_runway_v"] = _with() + "\nSELECT cash_runway FROM bundle_v"
    q["liquidity_ratio"] = _with() + "\nSELECT liquidity_ratio FROM bundle"
    q["liquidity_ratio_v"] = _with() + "\nSELECT liquidity_ratio FROM liq_v"
    q["liquidity_ratio_doc"] = _with() + """
SELECT CASE WHEN b.burn_rate > 0 THEN round_even(CAST((SELECT saldo FROM bal) AS DOUBLE) / b.burn_rate, 2) END AS liquidity_ratio
FROM burn b"""
    q["collection_rate"] = _with() + "\nSELECT collection_rate FROM bundle"
    cr_cut = p.as_of - timedelta(days=90)
    q["collection_rate_doc"] = _with() + f"""
SELECT coalesce({share("coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN collected_amt END), 0)",
                       "coalesce(sum(CASE WHEN move_type = 'out_invoice' THEN amount_total END), 0)")}, 0.0) AS collection_rate
FROM staging WHERE invoice_date >= {_d(cr_cut)}"""
    q["exposure_totals"] = _with() + "\nSELECT total_cxc, cxc_vencida, n_criticas FROM bundle"
    q["exposure_totals_v"] = _with() + "\nSELECT total_ar, overdue_ar FROM exp_v"
    q["kpi_bundle"] = _with() + """
SELECT dso, burn_rate, cash_runway, saldo_liquido, liquidity_ratio, collection_rate, total_cxc, cxc_vencida,
  n_criticas, color_dso, color_runway, color_liq, color_tasa FROM bundle_c"""
    q["kpi_bundle_at"] = q["kpi_bundle"].replace(_with(), _with(p=EARLIER))
    q["kpi_bundle_v"] = _with() + """
SELECT dso, burn_rate, cash_runway, liquidity_ratio, total_cash, total_ar, overdue_ar FROM bundle_v"""
    q["kpi_levels_v"] = _with() + """
SELECT CASE WHEN cash_runway > 6 THEN 'success' WHEN cash_runway > 3 THEN 'warning' ELSE 'danger' END AS color_runway,
  CASE WHEN dso < 30 THEN 'success' WHEN dso < 45 THEN 'warning' ELSE 'danger' END AS color_dso,
  CASE WHEN liquidity_ratio > 1.5 THEN 'success' WHEN liquidity_ratio > 1.0 THEN 'warning' ELSE 'danger' END AS color_liq
FROM bundle_v"""

    q["aging_report"] = _with(_aging().split("\nSELECT")[0]) + "\nSELECT" + _aging().split("\nSELECT", 1)[1]
    q["aging_positions"] = q["aging_report"].replace(
        "SELECT tramo_aging AS tramo", "SELECT tramo_orden AS posicion, tramo_aging AS tramo")
    q["refresh_stream"] = q["aging_report"]
    q["refresh_stream_kpis"] = q["kpi_bundle"]
    q["overdue_aging_v"] = _with(f"""ov AS (
  SELECT CASE WHEN {days} <= 0 THEN NULL WHEN {days} <= 30 THEN {o[0]} WHEN {days} <= 60 THEN {o[1]}
              WHEN {days} <= 90 THEN {o[2]} WHEN {days} > 90 THEN {o[3]} END AS tramo, amount_residual
  FROM staging_v WHERE move_type = 'out_invoice' AND is_overdue
)""") + f"""
SELECT tramo, {money('sum(amount_residual)')} AS amount_residual FROM ov WHERE tramo IS NOT NULL GROUP BY tramo"""
    q["overdue_aging_v_period"] = q["overdue_aging_v"].replace(
        "AND is_overdue\n", "AND is_overdue AND invoice_date BETWEEN DATE '2001-05-01' AND DATE '2001-07-31'\n")
    q["monthly_facts"] = _with() + f"""
SELECT month, move_type, {money('sum(amount_total)')} AS total, {money('sum(collected_amt)')} AS collected,
  CAST(count(id) AS BIGINT) AS n, CAST(sum(CASE WHEN is_collected THEN 1 ELSE 0 END) AS BIGINT) AS n_closed,
  avg(CASE WHEN is_collected THEN dias END) AS mean_days
FROM staging GROUP BY month, move_type"""
    mc = _monthly("staging", p.history_months, ("facturado", "cobrado", "n_facturas", "tasa_cobro"), True)
    q["monthly_comparison"] = _with(mc.split("\nSELECT")[0]) + "\nSELECT" + mc.split("\nSELECT", 1)[1]
    q["report_targets"] = q["monthly_comparison"].replace(
        "AS month_dt FROM m", "AS month_dt, CAST(80.0 AS DOUBLE) AS meta_cobro FROM m")
    mv = _monthly("staging_v", p.history_months, ("invoiced", "collected", "count", "collection_rate"), False)
    q["monthly_comparison_v"] = _with(mv.split("\nSELECT")[0]) + "\nSELECT" + mv.split("\nSELECT", 1)[1]
    q["monthly_net_cashflow"] = _with(_net(p.net_months)) + "\nSELECT * FROM net"
    q["net_cashflow_empty"] = _with(_net(p.net_months), p=NO_MOVES) + "\nSELECT * FROM net"
    q["waterfall_labels"] = _with(_net(10)) + """
SELECT *, CASE WHEN tipo = 'relative' THEN strftime(month_dt, '%b %y') ELSE 'Total' END AS etiqueta FROM net"""
    q["client_concentration"] = _with(f"""per AS (
  SELECT partner_name, sum(amount_residual) AS m FROM staging
  WHERE move_type = 'out_invoice' AND amount_residual > 0 GROUP BY partner_name
),
top AS (SELECT partner_name, m FROM per ORDER BY m DESC, partner_name LIMIT {p.top_clients}),
tot AS (SELECT sum(m) AS total FROM per),
oth AS (SELECT 'Otros' AS partner_name, total - (SELECT coalesce(sum(m), 0) FROM top) AS m FROM tot),
rowsx AS (SELECT * FROM top UNION ALL SELECT * FROM oth WHERE m > 0)""") + f"""
SELECT partner_name AS cliente, {money('m')} AS monto, {share('m', '(SELECT total FROM tot)')} AS porcentaje FROM rowsx"""
    q["refresh_stream_concentration"] = q["client_concentration"]
    q["collections_velocity"] = _with(f"""g AS (
  SELECT month, avg(dias) AS d, count(id) AS n FROM staging
  WHERE move_type = 'out_invoice' AND is_collected GROUP BY month HAVING count(id) >= {p.min_velocity_sample}
  ORDER BY month DESC LIMIT {p.history_months}
),
h AS (SELECT month, round_even(d, 1) AS dso_mes, CAST(n AS BIGINT) AS n_fact, CAST(month || '-01' AS DATE) AS month_dt FROM g)""") + """
SELECT month, dso_mes, n_fact, month_dt,
  round_even(avg(dso_mes) OVER (ORDER BY month_dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 1) AS dso_ma3 FROM h"""
    q["velocity_targets"] = q["collections_velocity"].replace(
        "AS dso_ma3 FROM h", "AS dso_ma3, CAST(45.0 AS DOUBLE) AS umbral_dso FROM h")
    q["journal_breakdown"] = _with() + f"""
SELECT name, type, {money('current_balance')} AS current_balance FROM journals WHERE type IN ('bank', 'cash')"""
    q["critical_invoices"] = _with(_critical(p.top_critical)) + "\nSELECT * FROM crit"
    q["grand_totals"] = _with("""gt AS (
  SELECT coalesce(sum(CASE WHEN move_type = 'out_invoice' AND amount_residual > 0 AND tramo_orden IS NOT NULL
                      THEN amount_residual END), 0) AS p, (SELECT saldo FROM bal) AS s FROM staging
)""") + f"""
SELECT {money('p')} AS total_pendiente, {money('s')} AS saldo_diarios,
  {_money_text('p')} AS total_pendiente_txt, {_money_text('s')} AS saldo_diarios_txt FROM gt"""
    h = S.CRITICAL_TABLE_HEADERS
    q["critical_invoices_display"] = _with(_critical(p.top_critical)) + f"""
SELECT name AS "{h['name']}", partner_name AS "{h['partner_name']}", invoice_date AS "{h['invoice_date']}",
  date_maturity AS "{h['date_maturity']}", {_money_text('amount_total')} AS "{h['amount_total']}",
  {_money_text('amount_residual')} AS "{h['amount_residual']}", days_overdue AS "{h['days_overdue']}",
  nivel_riesgo AS "{h['nivel_riesgo']}" FROM crit"""

    g, gv = grid
    q["cashflow_projection"] = _with(_grid(100, 101, 1)) + f"\nSELECT {_proj_cols()} FROM proj"
    q["projection_mirrored"] = f"SELECT *, CASE WHEN egreso = 0 THEN 0.0 ELSE -egreso END AS egreso_neg FROM ({q['cashflow_projection']}) x"
    q["scenario_grid_at"] = _with(_grid(g.start, g.stop, g.step, as_of=EARLIER.as_of), p=EARLIER) + \
        f"\nSELECT pct, {_proj_cols()} FROM proj"
    q["scenario_grid"] = _with(_grid(g.start, g.stop, g.step)) + f"\nSELECT pct, {_proj_cols()} FROM proj"
    q["whatif_runway"] = _with(_scenarios(g.start, g.stop, g.step), f"""net AS (
  SELECT coalesce(sum(base_in), 0) AS tin, coalesce(sum(base_out), 0) AS tout FROM daily
  WHERE fecha < {_d(p.as_of + timedelta(days=p.horizon_days))}
),
fin AS (
  SELECT s.pct,
    greatest((SELECT saldo FROM bal) + (SELECT tin FROM net) * s.c - (SELECT tout FROM net), CAST(0 AS DECIMAL(18,2))) AS final,
    (SELECT burn_rate FROM burn) AS burn_rate,
    (EXISTS (SELECT 1 FROM staging) AND (SELECT burn_rate FROM burn) > 0) AS ok
  FROM scen s
),
rw AS (SELECT *, CASE WHEN ok THEN round_even(CAST(final AS DOUBLE) / burn_rate, 1) END AS runway_proy FROM fin)""") + f"""
SELECT pct, {money('final', 6)} AS saldo_final, runway_proy,
  CASE WHEN ok THEN CAST(CAST(runway_proy AS DECIMAL(38,1)) AS VARCHAR) || ' m' ELSE 'N/D' END AS runway_str,
  CASE WHEN NOT ok THEN 'muted' WHEN runway_proy < 3 THEN 'danger' WHEN runway_proy < 6 THEN 'warning' ELSE 'success' END AS nivel
FROM rw"""
    q["min_collection_rate"] = _with(_grid(g.start, g.stop, g.step), """per AS (
  SELECT pct, min(saldo) AS low, arg_max(saldo, fecha) AS last FROM proj GROUP BY pct
)""") + f"""
SELECT CAST(min(CASE WHEN low > 0 THEN pct END) AS INTEGER) AS min_cobrabilidad_pct,
  {money('max(CASE WHEN pct = 85 THEN last END) - max(CASE WHEN pct = 75 THEN last END)', 6)} AS impacto_caida
FROM per"""
    for key, at in (("break_even_rate", PARAMS), ("break_even_rate_at", EARLIER)):
        last = at.as_of + timedelta(days=at.horizon_days)
        q[key] = _with(f"""due AS (
  SELECT fecha, coalesce(base_in, 0) AS i, coalesce(base_out, 0) AS o FROM daily WHERE fecha < {_d(last)}
  UNION ALL SELECT {_d(at.as_of)}, 0, 0
),
per_day AS (SELECT fecha, sum(i) AS i, sum(o) AS o FROM due GROUP BY fecha),
sums AS (
  SELECT CAST(100 * sum(i) OVER w AS HUGEINT) AS den,
    CAST(100 * (sum(o) OVER w - (SELECT saldo FROM bal)) AS HUGEINT) AS num
  FROM per_day WINDOW w AS (ORDER BY fecha)
),
rates AS (
  SELECT CASE WHEN num <= 0 THEN 0 WHEN den > 0 THEN (num * 100000000 + den - 1) // den END AS rate,
    CASE WHEN num < 0 THEN 0 WHEN den > 0 THEN 5 * (20 * num // den + 1) END AS position
  FROM sums
)""", p=at) + """
SELECT CASE WHEN ok THEN round_even(CAST(rate AS DOUBLE) / 1000000, 6) END AS break_even_pct,
  CASE WHEN ok AND position <= 100 THEN CAST(position AS INTEGER) END AS min_cobrabilidad_pct
FROM (SELECT max(rate) AS rate, max(position) AS position,
  count(rate) = count(*) AND count(position) = count(*) AND EXISTS (SELECT 1 FROM staging) AS ok FROM rates)"""
    q["projected_cash_doc"] = _with(_scenarios(g.start, g.stop, g.step), """recv AS (
  SELECT coalesce(sum(amount_residual), 0) AS cxc FROM staging WHERE move_type = 'out_invoice'
)""") + f"""
SELECT s.pct, {money(f"(SELECT saldo FROM bal) + (SELECT cxc FROM recv) * s.c - CAST((SELECT burn_rate FROM burn) AS DECIMAL(18,2)) * CAST({p.horizon_days / 30:.6f} AS DECIMAL(10,6))", 6)} AS caja_proyectada
FROM scen s"""
    q["cashflow_projection_v"] = _with(_grid_v(0, 1, 1)) + f"\nSELECT {_PROJ_V_COLS} FROM proj_v"
    q["projection_mirrored_v"] = f"SELECT *, CASE WHEN outflow = 0 THEN 0.0 ELSE -outflow END AS outflow_neg FROM ({q['cashflow_projection_v']}) x"
    q["scenario_grid_v"] = _with(_grid_v(gv.start, gv.stop, gv.step)) + \
        f"\nSELECT impayment_pct, {_PROJ_V_COLS} FROM proj_v"

    runway_txt = "CAST(CAST(cash_runway AS DECIMAL(38,1)) AS VARCHAR)"
    q["alerts"] = _with() + f"""
SELECT * FROM (
  SELECT CASE WHEN cash_runway < 3 THEN 'danger' WHEN cash_runway < 6 THEN 'warning' END AS severity,
    'cash_runway' AS code,
    CASE WHEN cash_runway < 3
      THEN 'ALERTA CRÍTICA — Cash Runway de ' || {runway_txt} || ' meses. Liquidez insuficiente para 90 días de operación.'
      ELSE 'ADVERTENCIA — Cash Runway de ' || {runway_txt} || ' meses. Revisar plan de cobranza.' END AS message
  FROM bundle
  UNION ALL
  SELECT CASE WHEN n_criticas > 0 THEN CASE WHEN n_criticas < 10 THEN 'warning' ELSE 'danger' END END,
    'overdue_invoices', CAST(n_criticas AS VARCHAR) || ' facturas con más de 60 días vencidas detectadas.'
  FROM bundle
) WHERE severity IS NOT NULL"""
    q["critical_badge"] = _with(_critical(p.top_critical), "cn AS (SELECT CAST(count(*) AS BIGINT) AS n FROM crit)") + """
SELECT n, CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' facturas' ELSE 'Sin alertas' END AS texto,
  CASE WHEN n > 5 THEN 'danger' WHEN n > 0 THEN 'warning' ELSE 'success' END AS color FROM cn"""
    q["kpi_display"] = _with() + f"""
SELECT {_money_text('saldo_liquido')} AS saldo_liquido_txt,
  CAST(CAST(dso AS DECIMAL(38,1)) AS VARCHAR) || ' días' AS dso_txt,
  {_money_text('burn_rate')} || '/m' AS burn_rate_txt,
  CASE WHEN cash_runway = CAST('inf' AS DOUBLE) THEN '∞' ELSE CAST(CAST(cash_runway AS DECIMAL(38,1)) AS VARCHAR) || ' m' END AS cash_runway_txt,
  CASE WHEN cash_runway < 3 THEN 'CRÍTICO' ELSE 'OK' END AS runway_badge,
  CASE WHEN liquidity_ratio < 90 THEN format('{{:,.2f}}', liquidity_ratio) || '×' ELSE '>90×' END AS liquidity_ratio_txt,
  {_money_text('total_cxc')} AS total_cxc_txt,
  {_money_text('cxc_vencida')} AS cxc_vencida_txt,
  CAST(CAST(collection_rate AS DECIMAL(38,1)) AS VARCHAR) || '%' AS collection_rate_txt
FROM bundle"""
    return q
