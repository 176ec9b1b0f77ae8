"""Page files of the ERP's ``search_read`` as a Spark data source.

A page is one JSON file with the records of one call, a list of objects as the
server returns them: many-to-one fields are ``[id, "name"]`` or ``false``, empty
dates are ``false``, amounts are numbers. The pages of a model lie in one
folder. A task reads a page of its own while they are few, else a run of pages of
about ``TASK_BYTES``: starting a task costs more than reading a page. A page (a
call's record limit) is all that a task holds at a time.

Rows come out as the raw text columns that :mod:`caudal.sources.decode` reads.
Equality, membership and lower bounds on those columns are taken over by the
reader, which then builds Arrow batches of the matching records alone: the
``search_read`` domain of the extraction (type, state, date). Bounds compare
text, as Spark would; the server's dates are ISO, for which that is their order.

Written, a column of records (JSON text) is cut into compressed pages by each task,
under names that readers skip; when all tasks are done, the pages of those attempts
that count get the names they are read by.

    register_pages(spark)
    spark.read.format("erp_pages").schema(S.RAW_MOVES_SCHEMA).load("<folder of pages>")
    records.write.format("erp_pages").option("page_records", 2000).mode("append").save("<folder of pages>")
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from json.encoder import encode_basestring_ascii

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, WriterCommitMessage)

from caudal import schema as S
from caudal.sources import decode
from caudal.sources.ledger import Ledger

FORMAT = "erp_pages"
TASK_BYTES = 4 << 20  # of page files, as they lie in the folder: what one task reads
TASKS = 64  # of a folder with less than so many times TASK_BYTES, its pages sufficing
RAW_SCHEMAS = {"moves": S.RAW_MOVES_SCHEMA, "payments": S.RAW_PAYMENTS_SCHEMA, "journals": S.RAW_JOURNALS_SCHEMA}


def field_text(value: object) -> str | None:
    """A field as the export writes it: ``false``, numbers and many-to-one pairs as JSON, text as it is."""
    if value is None or isinstance(value, str):
        return value
    if type(value) is list and len(value) == 2 and type(value[0]) is int and type(value[1]) is str:
        return f"[{value[0]}, {encode_basestring_ascii(value[1])}]"  # as json.dumps below, sooner
    return str(value) if isinstance(value, (int, Decimal)) and not isinstance(value, bool) else json.dumps(value, default=str)


def _column(values: list[object]) -> pa.Array:
    """The values of a field as text; those of a field that is text in all records are taken as they are."""
    try:
        return pa.array(values, pa.string())
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array([field_text(v) for v in values], pa.string())


def _holds(f: Filter, column: pa.Array) -> pa.BooleanArray:
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array(f.value, pa.string()), skip_nulls=True)
    compare = pc.equal if isinstance(f, EqualTo) else pc.greater_equal  # by bytes
    return pc.fill_null(compare(column, pa.scalar(f.value, pa.string())), False)


class PagesReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.fieldNames()
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual, IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True))
        files = [f for f in sorted(files, key=lambda f: f.path)
                 if f.is_file and f.size and not f.base_name.startswith((".", "_"))]
        most = min(TASK_BYTES, sum(f.size for f in files) // TASKS)
        tasks: list[list[str]] = []
        filled = 0
        for f in files:
            if not tasks or filled + f.size > most:
                tasks.append([])
                filled = 0
            tasks[-1].append(f.path)
            filled += f.size
        return [InputPartition(paths) for paths in tasks]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        system, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for path in partition.value if partition else ():  # none: a folder without pages
            with system.open_input_stream(path) as page:
                text = page.read()  # a compressed file is unpacked by its ending
            records = json.loads(text, parse_float=Decimal) if text else []
            if self.filters:
                tested = {n: _column([r.get(n) for r in records]) for n in {f.attribute[0] for f in self.filters}}
                kept = reduce(pc.and_, (_holds(f, tested[f.attribute[0]]) for f in self.filters))
                records = [records[i] for i in pc.indices_nonzero(kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([_column([r.get(n) for r in records]) for n in self.names], names=self.names)


def _pages(batches: Iterator[pa.RecordBatch], page_records: int) -> Iterator[pa.Buffer]:
    """One column of records, in any batches, to texts of lists of ``page_records`` of them; the last may be shorter."""
    held: list[pa.Array] = []

    def page() -> pa.Buffer:
        records = pa.concat_arrays(held)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(records)], records), ", ")
        return pc.binary_join_element_wise("[", joined, "]", "")[0].as_buffer()

    for batch in batches:
        records = batch.column(0)
        while len(records):
            held.append(records.slice(0, page_records - sum(map(len, held))))
            records = records.slice(len(held[-1]))
            if sum(map(len, held)) == page_records:
                yield page()
                held.clear()
    if held:
        yield page()


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    """What an attempt wrote: its pages are ``stem-0`` and so on."""
    stem: str
    pages: int


class PagesWriter(DataSourceArrowWriter):
    """Pages are written under hidden names and shown by the commit, so a lost or repeated attempt adds none."""

    def __init__(self, path: str, page_records: int):
        self.path, self.page_records, self.id = path, page_records, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        task, pages = TaskContext.get(), 0
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.id}"
        for text in _pages(iterator, self.page_records):
            with system.open_output_stream(f"{folder}/.{self._name(stem, pages)}", compression=None) as page:
                page.write(gzip.compress(text, 1))
            pages += 1
        return Written(stem, pages)

    @staticmethod
    def _name(stem: str, page: int) -> str:
        return f"{stem}-{page:06d}.json.gz"

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        names = [self._name(m.stem, i) for m in messages if m for i in range(m.pages)]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: system.move(f"{folder}/.{name}", f"{folder}/{name}"), names))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes what is left hidden of this write."""
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        for f in system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
            if f.is_file and f.base_name.startswith(".part-") and self.id in f.base_name:
                system.delete_file(f.path)


class ErpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        raise ValueError(f"give the raw schema of the table: spark.read.format({FORMAT!r}).schema(...)")

    def reader(self, schema: T.StructType) -> PagesReader:
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("pages are read as text, then decoded")
        return PagesReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PagesWriter:
        if overwrite or [f.dataType for f in schema.fields] != [T.StringType()]:
            raise ValueError("one column of records is added to a folder of pages")
        return PagesWriter(self.options["path"], int(self.options["page_records"]))


def register_pages(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ErpPages)


def read_pages(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The raw text rows of one table's pages."""
    register_pages(spark)
    return spark.read.format(FORMAT).schema(RAW_SCHEMAS[table]).load(f"{path}/{table}")


def load_pages(spark: SparkSession, path: str, since: str | None = None) -> Ledger:
    """The ledger of the pages under ``path``; with ``since`` (an ISO date) only
    what the extraction asks for: posted customer invoices and vendor bills, and
    payments, issued since then, and bank and cash journals."""
    moves, payments, journals = (read_pages(spark, path, t) for t in ("moves", "payments", "journals"))
    if since:
        moves = moves.filter(moves.move_type.isin(S.OUT_INVOICE, S.IN_INVOICE) & (moves.state == S.POSTED)
                             & (moves.invoice_date >= since) & (moves.invoice_date != "false"))
        payments = payments.filter((payments.state == S.POSTED) & (payments.date >= since) & (payments.date != "false")
                                   & payments.payment_type.isin(S.INBOUND, S.OUTBOUND))
        journals = journals.filter(journals.type.isin(*S.LIQUID_JOURNAL_TYPES))
    return Ledger(decode.decode_moves(moves), decode.decode_payments(payments), decode.decode_journals(journals))
