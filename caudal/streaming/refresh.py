"""Refresh job: bring every report up to date whenever a new extract arrives.

The reference recomputes everything from a fresh extract every five minutes
(or on a button). An extract here is one folder, put in place in one move
(:func:`write_extract`)::

    <inbox>/extract_seq=<n>/extract_date=<day>/bucket=<b>/...parquet   all moves of the window
    <inbox>/_digests/extract_seq=<n>/extract_date=<day>.json           one digest per bucket
    <extras>/payments, <extras>/journals                               as they are now

Each extract is complete: it replaces the one before, so a document that is
cancelled, unposted or out of the window is gone with the next. A Structured
Streaming file source watches the inbox. A micro-batch only says that there is
something new; the job then takes the newest extract of each date the batch
holds, and publishes all reports under the extract's own date (with a fixed
``as_of``, those of the newest extract of all). An older extract of a date is
superseded.

The work follows the change, not the ledger. Documents are dealt into buckets by
a hash of their id. Only the buckets whose digest differs from the former
extract's are read: their old rows, with a minus, and their new ones, with a
plus, are summed into a few :mod:`caudal.operators.facts`, which are added to
those before. The staged table and the candidates for the critical invoices are
replaced in those buckets alone as long as the as-of date stays the same; on a
new date, when days overdue move for every document, they are made afresh from
one scan (the facts hold for any date). Without usable state (first extract,
former one cleared from the inbox, other number of buckets) everything is made
from the whole extract.

State is one small file per tick, which names the extract, its digests and the
folders of facts (the facts themselves are sums, not moves). It is moved into
place after the reports are published: a tick that dies is done again from the
state before it, with the same result. Progress of the source lives in the
checkpoint under the shared folder, so the job resumes after a driver or
executor loss. Tests and the registered queries run it with ``availableNow``;
production uses ``processingTime='5 minutes'``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caudal import schema as S
from caudal.functions import columns as C
from caudal.operators import facts as X
from caudal.operators.staging import stage
from caudal.plans.publish import finish
from caudal.session import (build_session, delete_path, file_names, move_folder, path_exists, read_text, shared_dir,
                            subfolders, write_text)
from caudal.sources.history import HISTORY, Renamed, resolve
from caudal.sources.ledger import Ledger, load_ledger, main_ledger, moves_source
from caudal.sources.sinks import Refresh, published, read_folders, read_report

EXTRACT = ("extract_seq", "extract_date")
BUCKET = "bucket"
BUCKETS = 16  # of the registered queries; a bucket of a large ledger should hold about a gigabyte
FACT_FOLDERS = 16  # so many additions to the facts are summed into one
EXTRACT_SCHEMA = T.StructType([*S.MOVES_SCHEMA.fields, T.StructField("extract_seq", T.LongType()),
                               T.StructField("extract_date", T.DateType()), T.StructField(BUCKET, T.IntegerType())])

# Registered query to the report it returns.
STREAM_REPORTS = {"refresh_stream": "aging_report", "refresh_stream_kpis": "kpi_bundle",
                  "refresh_stream_concentration": "client_concentration"}


# -- extracts ----------------------------------------------------------------------------


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _row_hashes(columns: list[str]) -> list[Column]:
    """Rows, and two sums of 64-bit hashes over all columns: equal for equal rows in any order."""
    hashes = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return [F.count(F.lit(1)).cast("string").alias("n"),
            *(F.sum(h.cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i, h in enumerate(hashes))]


def digests(moves: DataFrame, buckets: int) -> dict[str, list[str]]:
    """What each bucket holds, as :func:`_row_hashes`."""
    rows = moves.groupBy(bucket_of(buckets).alias(BUCKET)).agg(*_row_hashes(S.MOVES_SCHEMA.fieldNames())).collect()
    return {str(r[0]): list(r[1:]) for r in rows}


def _extract(inbox: str, seq: int, day: date) -> str:
    return f"{inbox}/extract_seq={seq}/extract_date={day.isoformat()}"


def _digest_file(path: str) -> str:
    inbox, seq, day = path.rsplit("/", 2)
    return f"{inbox}/_digests/{seq}/{day}.json"


def write_extract(moves: DataFrame, inbox: str, seq: int, day: date, buckets: int = BUCKETS) -> None:
    """One full extract, laid out by bucket, with its digests; it appears in the inbox in one move.

    Each task writes its own rows of every bucket, so the moves are not shuffled and no task holds a whole bucket."""
    spark = moves.sparkSession
    aside, path = f"{inbox}/_incoming/{uuid.uuid4().hex}", _extract(inbox, seq, day)
    (moves.select(*S.MOVES_SCHEMA.fieldNames(), bucket_of(buckets).alias(BUCKET))
     .write.option("compression", "zstd").partitionBy(BUCKET).parquet(aside))
    found = digests(spark.read.schema(S.MOVES_SCHEMA).parquet(aside), buckets)
    write_text(spark, _digest_file(path), json.dumps({"buckets": buckets, "digests": found}))
    move_folder(spark, aside, path)


def extract_digests(spark: SparkSession, path: str, buckets: int, history: tuple[Renamed, ...] = HISTORY) -> dict[str, list[str]]:
    """Digests of an extract: as delivered with it, or else by one scan."""
    if path_exists(spark, _digest_file(path)):
        said = json.loads(read_text(spark, _digest_file(path)))
        if said["buckets"] == buckets:
            return said["digests"]
    return digests(_moves(spark, path, [path], history), buckets)


def _moves(spark: SparkSession, path: str, folders: list[str], history: tuple[Renamed, ...]) -> DataFrame:
    """Moves in ``folders`` of the extract at ``path``, by the columns that its files have and its date."""
    if not any(file_names(spark, f) or subfolders(spark, f) for f in folders):
        return spark.createDataFrame([], S.MOVES_SCHEMA)
    day = date.fromisoformat(path.rsplit("extract_date=", 1)[1].split("/")[0])
    return resolve(spark.read.parquet(*folders), "moves", S.MOVES_SCHEMA, day, history)


def bucket_rows(spark: SparkSession, path: str, chosen: list[int] | None, buckets: int,
                history: tuple[Renamed, ...] = HISTORY) -> DataFrame:
    """Moves of an extract, with their bucket: of the ``chosen`` buckets, whose folders alone are read, or of all."""
    laid_out = path_exists(spark, _digest_file(path)) and json.loads(read_text(spark, _digest_file(path)))["buckets"] == buckets
    if chosen is not None and laid_out:
        names = [f for f in subfolders(spark, path) if f.startswith(f"{BUCKET}=") and int(f.split("=", 1)[1]) in set(chosen)]
        return _moves(spark, path, [f"{path}/{f}" for f in names], history).withColumn(BUCKET, bucket_of(buckets))
    rows = _moves(spark, path, [path], history).withColumn(BUCKET, bucket_of(buckets))
    return rows if chosen is None else rows.filter(F.col(BUCKET).isin(chosen))


def _newest(spark: SparkSession, path: str, column: str) -> str | None:
    values = [f.split("=", 1)[1] for f in subfolders(spark, path) if f.startswith(f"{column}=")]
    return max(values, key=lambda v: (len(v), v), default=None)  # numbers and ISO dates alike


def newest_extract(spark: SparkSession, inbox: str) -> tuple[str, date] | None:
    """Folder and date of the newest extract in ``inbox``: found by its folder's name."""
    seq = _newest(spark, inbox, "extract_seq")
    day = seq and _newest(spark, f"{inbox}/extract_seq={seq}", "extract_date")
    return (_extract(inbox, int(seq), date.fromisoformat(day)), date.fromisoformat(day)) if day else None


def newest_extracts(spark: SparkSession, inbox: str, held: list[tuple[int, date]]) -> list[tuple[str, date]]:
    """Folder and date of the newest extract in ``inbox`` of each date in ``held`` (numbers and dates), oldest first.

    Folders older than those in ``held`` are not listed.
    """
    days, least = {day for _, day in held}, min((seq for seq, _ in held), default=0)
    found: dict[date, int] = {}
    for f in subfolders(spark, inbox):
        if f.startswith("extract_seq=") and (seq := int(f.split("=", 1)[1])) >= least:
            for g in subfolders(spark, f"{inbox}/{f}"):
                if g.startswith("extract_date=") and (day := date.fromisoformat(g.split("=", 1)[1])) in days:
                    found[day] = max(found.get(day, seq), seq)
    return [(_extract(inbox, seq, day), day) for day, seq in sorted(found.items(), key=lambda x: (x[1], x[0]))]


# -- one tick ----------------------------------------------------------------------------

CANDIDATES = "critical_candidates"
CANDIDATE_COLUMNS = ("id", "name", "partner_name", "move_type", "invoice_date", "date_maturity", "amount_total",
                     "amount_residual", "days_overdue", "nivel_riesgo", BUCKET)


def _candidates(staged: DataFrame, p: S.Params, buckets: int) -> DataFrame:
    """Of each bucket the overdue invoices that may be among the most critical of all."""
    first = Window.partitionBy(BUCKET).orderBy(C.residual().desc(), "name", "id")
    return (staged.filter(C.customer_invoice() & C.overdue(p.as_of)).withColumn(BUCKET, bucket_of(buckets))
            .select(*CANDIDATE_COLUMNS, F.row_number().over(first).alias("_rank"))
            .filter(F.col("_rank") <= p.top_critical).drop("_rank"))


def _bucket(folder: str) -> int:
    return int(folder.rsplit(f"/{BUCKET}=", 1)[1])


def _window_tables(tables: Refresh, moves: DataFrame, former: dict[str, list[str]] | None, changed: list[int] | None,
                   p: S.Params, buckets: int) -> None:
    """The staged table and the candidates, of which ``former`` is right but for the ``changed`` buckets (None: all)."""
    spark = tables.spark
    staged = stage(moves_source(moves, p.as_of, p.lookback_days), p.as_of)
    new: list[str] = []
    if changed != []:
        place = f"{tables.out}/{tables.folder('staging')}"
        staged.withColumn(BUCKET, bucket_of(buckets)).write.partitionBy(BUCKET).parquet(place)
        new = [f"{tables.folder('staging')}/{f}" for f in subfolders(spark, place) if f.startswith(f"{BUCKET}=")]
    kept = [] if changed is None else [f for f in former["staging"] if _bucket(f) not in changed]
    tables.reuse("staging", sorted([*kept, *new], key=_bucket), staged.schema)
    found = _candidates(read_folders(spark, [f"{tables.out}/{f}" for f in new], staged.schema), p, buckets)
    if changed is not None:
        before = read_folders(spark, [f"{tables.out}/{f}" for f in former[CANDIDATES]], found.schema)
        found = before.filter(~F.col(BUCKET).isin(changed)).unionByName(found) if changed else before
    tables.write(CANDIDATES, found)


def _states(spark: SparkSession, place: str) -> list[str]:
    return [f for f in file_names(spark, place) if f.endswith(".json")]


def refresh(spark: SparkSession, path: str, workdir: str, extras: Ledger, p: S.Params,
            buckets: int = BUCKETS, history: tuple[Renamed, ...] = HISTORY) -> list[int] | None:
    """Publish the reports of the extract at ``path``; returns the buckets that
    differ from the former extract's, None where all were read. ``history`` has
    the names that columns had over time."""
    place = f"{workdir}/state"
    names = _states(spark, place)
    state = json.loads(read_text(spark, f"{place}/{names[-1]}")) if names else None
    tick = int(names[-1].split(".")[0]) + 1 if names else 1
    now = extract_digests(spark, path, buckets, history)
    if state and (state["buckets"] != buckets or not path_exists(spark, state["extract"])):
        state = None
    changed = state and sorted(int(b) for b in {*now, *state["digests"]} if now.get(b) != state["digests"].get(b))
    paid, held = (list(df.agg(*_row_hashes(df.columns)).first()) for df in (extras.payments, extras.journals))
    tables = Refresh(spark, f"{workdir}/reports", p.as_of)
    former = published(spark, tables.out, p.as_of) if state and state["params"] == repr(p) else None
    made = list(state["facts"]) if state else []

    # With nothing new since the former publication of this date, that one stands.
    if former is None or changed or (state["payments"], state["journals"]) != (paid, held):
        folder = f"{place}/facts/{tick:012d}-{uuid.uuid4().hex[:8]}"
        if changed is None:
            X.ledger_facts(bucket_rows(spark, path, None, buckets, history)).write.parquet(folder)
            made = [folder]
        elif changed:
            old, new = (X.ledger_facts(bucket_rows(spark, e, changed, buckets, history)) for e in (state["extract"], path))
            X.summed(X.signed(old, -1), X.signed(new, 1)).write.parquet(folder)
            made.append(folder)
        if len(made) > FACT_FOLDERS:
            X.summed(read_folders(spark, made, X.SCHEMA)).write.parquet(f"{folder}-all")
            made = [f"{folder}-all"]
        facts = read_folders(spark, made, X.SCHEMA)

        todo = None if former is None else changed
        _window_tables(tables, bucket_rows(spark, path, todo, buckets, history), former, todo, p, buckets)
        main = main_ledger(Ledger(spark.createDataFrame([], S.MOVES_SCHEMA), extras.payments, extras.journals), p.as_of,
                           p.lookback_days)
        if former is not None and state["payments"] == paid:
            tables.reuse("payments", former["payments"], main.payments.schema)
        else:
            tables.write("payments", main.payments, one_file=False)
        tables.write("journals", main.journals)
        tables.write("facts", X.summed(facts.filter(F.col("kind") == X.DAY)))
        finish(tables, tables.read("facts"), X.summed(facts.filter(F.col("kind") == X.PARTNER)), tables.read(CANDIDATES),
               extras.payments, extras.journals, p)

    write_text(spark, f"{place}/{tick:012d}.json", json.dumps({
        "extract": path, "buckets": buckets, "digests": now, "facts": made, "params": repr(p), "payments": paid, "journals": held}))
    _clear_state(spark, place)
    return changed


def _clear_state(spark: SparkSession, place: str) -> None:
    """The two newest states are kept, with the facts they name."""
    names = _states(spark, place)
    used = {f for n in names[-2:] for f in json.loads(read_text(spark, f"{place}/{n}"))["facts"]}
    for f in subfolders(spark, f"{place}/facts"):
        if f"{place}/facts/{f}" not in used:
            delete_path(spark, f"{place}/facts/{f}")
    for n in names[:-2]:
        delete_path(spark, f"{place}/{n}")


def start_refresh(spark: SparkSession, inbox: str, workdir: str,
                  extras: Callable[[SparkSession], Ledger], p: S.Params | None = None, as_of: date | None = None,
                  available_now: bool = False, every: str = "5 minutes",
                  files_per_batch: int | None = None, buckets: int = BUCKETS,
                  history: tuple[Renamed, ...] = HISTORY) -> StreamingQuery:
    """Start the refresh stream over ``inbox``; reports go to ``workdir/reports``.

    ``extras`` is called in every batch and gives payments and journals as
    they are then. Reports are as of the extract's date unless ``as_of`` is
    given; ``p`` has the other parameters.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if as_of:  # one folder of reports, of the newest extract
            newest = newest_extract(session, inbox)
            found = [newest] if newest else []
        else:
            found = newest_extracts(session, inbox, [tuple(r) for r in batch.select(*EXTRACT).distinct().collect()])
        now = extras(session) if found else None
        for path, day in found:
            refresh(session, path, workdir, now, replace(p or S.Params(as_of=day), as_of=as_of or day), buckets, history)

    reader = spark.readStream.schema(EXTRACT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (reader.parquet(inbox).writeStream
              .foreachBatch(on_batch)
              .option("checkpointLocation", f"{workdir}/checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def extract_at(raw_moves: DataFrame, day: date) -> DataFrame:
    """The ledger as an extract of ``day`` returned it: a document paid after
    that day is still fully open in it, and one issued later is not there."""
    paid_later = F.col("payment_date") > C.lit_date(day)
    return (raw_moves.filter(F.col("invoice_date") <= C.lit_date(day))
            .withColumns({
                "amount_residual": F.when(paid_later, F.col("amount_total")).otherwise(F.col("amount_residual")),
                "payment_date": F.when(paid_later, F.lit(None).cast("date")).otherwise(F.col("payment_date"))}))


_RUNS: dict[tuple[str, str], str] = {}


def refresh_stream_query(spark: SparkSession, sf_dir: str, report: str = "aging_report") -> DataFrame:
    """Registered queries: run the stream over two extracts of the given tables
    to completion and return a report it wrote (equals the batch one). The
    queries share one run per state of the input files."""
    from caudal.plans import catalog
    from caudal.sources.tables import ledger_signature, map_payments, mapped_ledger

    p = catalog.PARAMS
    key = spark.sparkContext.applicationId, ledger_signature(spark, sf_dir)
    if key not in _RUNS:
        raw = mapped_ledger(spark, sf_dir, p.as_of)
        workdir = f"{shared_dir(spark)}/caudal/stream/{uuid.uuid4().hex}"
        inbox = f"{workdir}/inbox"
        # The mapping runs once: the former extract and the payments come from the moves just written.
        write_extract(raw.moves, inbox, 2, p.as_of)
        moves = spark.read.schema(S.MOVES_SCHEMA).parquet(_extract(inbox, 2, p.as_of))
        write_extract(extract_at(moves, date(2000, 12, 31)), inbox, 1, date(2000, 12, 31))
        extras = Ledger(moves, map_payments(moves), raw.journals)
        q = start_refresh(spark, inbox, workdir, lambda _: extras, p, available_now=True)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        _RUNS[key] = workdir
    return read_report(spark, f"{_RUNS[key]}/reports", report, p.as_of)


def main(argv: list[str] | None = None) -> None:
    """Production entry point: refresh every ``--every`` until stopped."""
    import argparse

    ap = argparse.ArgumentParser(description="caudal refresh stream")
    ap.add_argument("--inbox", required=True, help="folder receiving extracts of the moves (Parquet)")
    ap.add_argument("--ledger", required=True, help="ledger folder whose payments/ and journals/ are read at every tick")
    ap.add_argument("--workdir", required=True, help="shared folder for checkpoint and reports")
    ap.add_argument("--as-of", type=date.fromisoformat, help="fixed date of the reports (default: the extract's)")
    ap.add_argument("--every", default="5 minutes")
    ap.add_argument("--once", action="store_true", help="process what is there, then stop")
    args = ap.parse_args(argv)
    spark = build_session(app="caudal-refresh")
    q = start_refresh(spark, args.inbox, args.workdir, lambda s: load_ledger(s, args.ledger), as_of=args.as_of,
                      available_now=args.once, every=args.every)
    q.awaitTermination()


if __name__ == "__main__":
    main()
