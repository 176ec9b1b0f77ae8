"""The ledger derived from the TPC-H style test tables.

Customer orders become customer invoices, supplier shipments become vendor
bills (one per supplier, ship day and line status), and closed orders of the
last year give per-segment account balances. The rules (decimal before
multiply, due-date terms, bill ids) are fixed so that DuckDB can compute the
same rows from the same files.

Reports may run on the mapping as a plan. For many reports,
:func:`materialise_ledger` first writes the mapped ledger into the shared
folder named by ``spark.checkpoint.dir``: every report then reads a pruned,
pushed-down Parquet scan instead of re-running the joins, and the written
table survives the loss of any executor.
"""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import schema as S
from caudal.functions.columns import lit_date, zero_money
from caudal.session import input_bytes, input_signature, path_exists, shared_dir
from caudal.sources.ledger import Ledger

BALANCE_WINDOW_DAYS = 365
SOURCE_TABLES = ("orders", "customer", "lineitem", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _midnight(d: date, dtype: T.DataType) -> Column:
    """Midnight of ``d`` as a literal of the column's own timestamp type.

    Built from text, so it means the same wall-clock time as ``cast(col AS
    date)`` whatever the Python process's local zone is.
    """
    kind = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    return F.lit(f"{d.isoformat()} 00:00:00").cast(kind)


def _between_days(df: DataFrame, col: str, lo: date, hi: date) -> Column:
    """``cast(col AS date)`` in [lo, hi] written as a range on the raw column so the
    Parquet reader can push it down (a cast on the column cannot be pushed)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return (F.col(col) >= _midnight(lo, dtype)) & (F.col(col) < _midnight(hi + timedelta(days=1), dtype))
    return F.col(col).cast("date").between(lit_date(lo), lit_date(hi))


def _price(c: str) -> Column:
    return F.col(c).cast(S.MONEY)


TASK_BYTES = 8 << 20  # of a source file: what one task aggregates, joins and sorts


def _dealt(df: DataFrame, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """Rows of the table ``name`` dealt by ``keys`` into tasks of about ``TASK_BYTES`` of its file, for a grouping by
    these keys that hardly makes them fewer: a task's memory then stays the same however large the table is. A
    table that the cores share in smaller parts is left to Spark."""
    spark = df.sparkSession
    tasks = -(-input_bytes(spark, f"{sf_dir}/{name}.parquet") // TASK_BYTES)
    return df.repartition(tasks, *keys) if tasks > spark.sparkContext.defaultParallelism else df


def map_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices from orders and customer, bills from lineitem and supplier.

    Every row counts, whatever its date; a document whose partner is missing
    stays, as ``Sin partner``.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    odate = F.col("o_orderdate").cast("date")
    total = _price("o_totalprice")
    terms = (F.when(F.col("o_orderpriority") == "1-URGENT", 30)
             .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), 45)
             .otherwise(60))
    status = F.col("o_orderstatus")
    # The customer side is one row per key, so a hot customer only skews the
    # order side; AQE's skew-join splits that partition.
    invoices = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
                .select(
                    F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("INV/"), F.year(odate).cast("string"), F.lit("/"),
                             F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("name"),
                    F.lit(S.OUT_INVOICE).alias("move_type"),
                    F.when((F.col("o_orderpriority") == "5-LOW") & (status == "O"), "draft")
                     .otherwise(S.POSTED).alias("state"),
                    odate.alias("invoice_date"),
                    F.date_add(odate, terms).alias("date_maturity"),
                    total.alias("amount_total"),
                    F.when(status == "F", zero_money())
                     .when(status == "O", total)
                     .otherwise((total * F.lit(0.50).cast("decimal(3,2)")).cast(S.MONEY))
                     .alias("amount_residual"),
                    F.coalesce("c_name", F.lit(S.NO_PARTNER)).alias("partner_name"),
                    F.when(status == "F",
                           F.date_add(odate, (F.lit(5) + F.col("o_orderkey") % 60).cast("int")))
                     .alias("payment_date"),
                ))

    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    net = (F.col("l_extendedprice").cast("decimal(12,2)")
           * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast(S.MONEY)
    # Aggregate lines to one bill per supplier/day/status before touching the
    # supplier table: the join then sees one row per bill, not per line.
    bill = ("l_suppkey", "l_shipdate", "l_linestatus")
    per_bill = (_dealt(items.select(*bill, net.alias("net")), sf_dir, "lineitem", *bill).groupBy(*bill)
                .agg(F.sum("net").cast(S.MONEY).alias("bill_total")))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sdate = F.col("l_shipdate").cast("date")
    closed = F.col("l_linestatus") == "F"
    bills = (per_bill.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
             .select(
                 ((F.col("l_suppkey") * 100000000 + F.year(sdate) * 10000 + F.month(sdate) * 100
                   + F.dayofmonth(sdate)) * 10 + F.when(closed, 0).otherwise(1)).cast("bigint").alias("id"),
                 F.concat(F.lit("BILL/"), F.year(sdate).cast("string"), F.lit("/"),
                          F.lpad(F.col("l_suppkey").cast("string"), 7, "0"), F.lit("/"),
                          F.col("l_linestatus")).alias("name"),
                 F.lit(S.IN_INVOICE).alias("move_type"),
                 F.lit(S.POSTED).alias("state"),
                 sdate.alias("invoice_date"),
                 F.date_add(sdate, 30).alias("date_maturity"),
                 F.col("bill_total").alias("amount_total"),
                 F.when(closed, zero_money())
                  .otherwise((F.col("bill_total") * F.lit(0.40).cast("decimal(3,2)")).cast(S.MONEY))
                  .alias("amount_residual"),
                 F.coalesce("s_name", F.lit(S.NO_PARTNER)).alias("partner_name"),
                 F.when(closed, F.date_add(sdate, 20)).alias("payment_date"),
             ))
    return invoices.unionByName(bills)


def map_payments(moves: DataFrame) -> DataFrame:
    """One payment per paid document, dated on its payment date."""
    return (moves.filter(F.col("payment_date").isNotNull())
            .select("id",
                    F.col("payment_date").alias("date"),
                    F.col("amount_total").alias("amount"),
                    F.when(F.col("move_type") == S.OUT_INVOICE, S.INBOUND)
                     .otherwise(S.OUTBOUND).alias("payment_type"),
                    F.lit(S.POSTED).alias("state"),
                    "partner_name"))


def map_journals(spark: SparkSession, sf_dir: str, as_of: date) -> DataFrame:
    """One account per market segment, balance = closed orders of the last year.

    Orders are summed per customer *before* the customer join: partial
    aggregation collapses a hot customer to one row per task, and the join
    then sees one row per customer instead of one per order.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    orders = orders.filter((F.col("o_orderstatus") == "F") & _between_days(
        orders, "o_orderdate", as_of - timedelta(days=BALANCE_WINDOW_DAYS), as_of))
    per_customer = orders.groupBy("o_custkey").agg(F.sum(_price("o_totalprice")).alias("closed"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    seg = F.col("c_mktsegment")
    return (per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_mktsegment")
            .agg(F.sum("closed").cast(S.MONEY).alias("current_balance"))
            .select(
                (F.when(seg == "BUILDING", 1).when(seg == "MACHINERY", 2)
                 .when(seg == "HOUSEHOLD", 3).when(seg == "AUTOMOBILE", 4).otherwise(5))
                .cast("bigint").alias("id"),
                seg.alias("name"),
                F.when(seg.isin("BUILDING", "MACHINERY"), "bank")
                 .when(seg == "HOUSEHOLD", "cash").otherwise("general").alias("type"),
                "current_balance"))


PAYMENTS_MAPPED = T.StructType([f for f in S.PAYMENTS_SCHEMA.fields if f.name != "journal_tipo"])


def _write(df: DataFrame, path: str, sort_col: str, partition_cols: tuple[str, ...]) -> None:
    """Rows are rebalanced on the partition columns first (the ``rebalance``
    hint): one shuffle, no sampling pass over the upstream plan, few files per
    partition folder, and AQE splits a partition that holds a third of all
    rows across several writer tasks instead of giving it to one."""
    (df.hint("rebalance", *partition_cols).sortWithinPartitions(*partition_cols, sort_col)
     .write.mode("overwrite").partitionBy(*partition_cols).parquet(path))


# -- the materialised copy -----------------------------------------------------------


def ledger_signature(spark: SparkSession, sf_dir: str) -> str:
    """Names the ledger of these input files, by path, length and time of each."""
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES]
    sig = "|".join(input_signature(spark, p) for p in inputs)
    return hashlib.sha1(f"{sig}|v9".encode()).hexdigest()[:16]


def _base(spark: SparkSession, sf_dir: str) -> str:
    return f"{shared_dir(spark)}/caudal/ledger/{ledger_signature(spark, sf_dir)}"


def _with_periods(schema: T.StructType, *cols: str) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in cols)])


def _read_moves(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_with_periods(S.MOVES_SCHEMA, S.INVOICE_PERIOD)).parquet(f"{base}/moves")


_WHOLE: set[tuple[str, str]] = set()


def _committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A small table that was written by one task and has rows. A write that died
    half way has none, whatever folders and marker files it left."""
    if not path_exists(spark, path):
        return None
    df = spark.read.schema(schema).parquet(path)
    key = path.rstrip("/"), spark.sparkContext.applicationId  # what was whole once stays so: nothing is written twice
    if key not in _WHOLE and df.isEmpty():
        return None
    _WHOLE.add(key)
    return df


def _balances(base: str, as_of: date) -> str:
    return f"{base}/journals/as_of={as_of.isoformat()}"


def mapped_ledger(spark: SparkSession, sf_dir: str, as_of: date) -> Ledger:
    """Raw ledger of the given tables: what :func:`materialise_ledger` wrote of
    exactly these files, and the mapping itself, as a plan, for the rest. Never writes."""
    base = _base(spark, sf_dir)
    journals = _committed(spark, _balances(base, as_of), S.JOURNALS_SCHEMA)
    if journals is None:
        journals = map_journals(spark, sf_dir, as_of)
    if _committed(spark, f"{base}/manifest", "signature string") is not None:
        payments = spark.read.schema(_with_periods(PAYMENTS_MAPPED, S.PAYMENT_PERIOD)).parquet(f"{base}/payments")
        return Ledger(_read_moves(spark, base), payments, journals)
    moves = map_moves(spark, sf_dir).withColumn(S.INVOICE_PERIOD, F.date_format("invoice_date", S.PERIOD_PATTERN))
    payments = map_payments(moves).withColumn(S.PAYMENT_PERIOD, F.date_format("date", S.PERIOD_PATTERN))
    return Ledger(moves, payments, journals)


def materialise_ledger(spark: SparkSession, sf_dir: str, *as_of: date) -> None:
    """Write the mapped ledger once into the shared folder, and its balances at
    each date, so that reports read a pruned, pushed-down Parquet scan instead
    of the joins.

    Partitioned by type and invoice period (type filters and the look-back
    window prune folders) and sorted by invoice date inside each file (row-group
    statistics skip the rest of the window). The manifest comes last. What is
    there of these very files already is left as it is.
    """
    base = _base(spark, sf_dir)
    for day in as_of:
        if _committed(spark, _balances(base, day), S.JOURNALS_SCHEMA) is None:
            map_journals(spark, sf_dir, day).coalesce(1).write.mode("overwrite").parquet(_balances(base, day))
    if _committed(spark, f"{base}/manifest", "signature string") is not None:
        return
    moves = map_moves(spark, sf_dir).withColumn(S.INVOICE_PERIOD, F.date_format("invoice_date", S.PERIOD_PATTERN))
    _write(moves, f"{base}/moves", "invoice_date", S.LEDGER_PARTITIONS)
    # Payments come from the moves just written, not from the joins again.
    paid = map_payments(_read_moves(spark, base)).withColumn(S.PAYMENT_PERIOD, F.date_format("date", S.PERIOD_PATTERN))
    _write(paid, f"{base}/payments", "date", S.PAYMENT_PARTITIONS)
    spark.createDataFrame([(base,)], "signature string").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")
