"""Report sink: the tables of a refresh appear together, or not at all.

A refresh writes its tables under a version of its own and then publishes them
by one small manifest, which readers resolve::

    <out>/<table>/as_of=<date>/v=<version>/...            data, never overwritten
    <out>/_published/as_of=<date>/<version>.json          which folders make up the date

The manifest is moved into place in one step after the last table, so a reader
sees the whole of the former refresh until it sees the whole of the new one; a
job that dies in between leaves folders that no manifest names. A manifest may
name folders of earlier versions, so what has not changed is not written again.
The two newest manifests of a date are kept, with all they name (a reader that
resolved the former one can finish); the next publication clears the rest.
Versions of a date ascend; one job at a time publishes a date.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caudal.session import delete_path, file_names, path_exists, read_text, subfolders, write_text

KEEP = 2


def _manifests(out: str, as_of: date) -> str:
    return f"{out}/_published/as_of={as_of.isoformat()}"


def published(spark: SparkSession, out: str, as_of: date) -> dict[str, list[str]] | None:
    """The folders of each table of the newest refresh of a date, under ``out``."""
    names = file_names(spark, _manifests(out, as_of))
    return json.loads(read_text(spark, f"{_manifests(out, as_of)}/{names[-1]}")) if names else None


def read_report(spark: SparkSession, out: str, name: str, as_of: date, schema: T.StructType | None = None) -> DataFrame:
    """A published table of one date; with its ``schema`` no footer is read to plan."""
    tables = published(spark, out, as_of)
    if tables is None or name not in tables:
        raise LookupError(f"{name} is not published as of {as_of.isoformat()} under {out}")
    return read_folders(spark, [f"{out}/{f}" for f in tables[name]], schema)


def read_folders(spark: SparkSession, folders: list[str], schema: T.StructType | None) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)


class Refresh:
    """The tables of one refresh, until :meth:`commit` publishes them."""

    def __init__(self, spark: SparkSession, out: str, as_of: date):
        self.spark, self.out, self.as_of = spark, out, as_of
        names = file_names(spark, _manifests(out, as_of))
        last = int(names[-1].split("-")[0]) if names else 0
        self.version = f"{last + 1:012d}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, list[str]] = {}
        self.schemas: dict[str, T.StructType] = {}

    def folder(self, name: str) -> str:
        """This version's folder of a table, under ``out``."""
        return f"{name}/as_of={self.as_of.isoformat()}/v={self.version}"

    def write(self, name: str, df: DataFrame, one_file: bool = True, partitions: tuple[str, ...] = ()) -> None:
        """``one_file`` is for reports of bounded size: a shuffle of the finished
        rows into one file, so the stages that compute the report keep their
        parallelism. Tables that grow with the ledger are written as they come,
        under ``partitions`` below the version."""
        self.schemas[name] = df.schema
        if one_file:
            df = df.repartition(1)
        elif partitions:
            df = df.hint("rebalance", *partitions)
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.out}/{self.folder(name)}")
        self.tables[name] = [self.folder(name)]

    def write_all(self, reports: dict[str, DataFrame], parallel: int = 4) -> None:
        """Write every (bounded) report; independent reports run as concurrent Spark jobs.

        Each report is a small job of a few short stages, so submitting them
        from a few driver threads keeps the executors busy instead of waiting
        on one job's tail at a time. Any failure is raised after all finished.
        """
        with ThreadPoolExecutor(max_workers=parallel, thread_name_prefix="caudal-report") as pool:
            for f in [pool.submit(self.write, name, df) for name, df in reports.items()]:
                f.result()

    def reuse(self, name: str, folders: Iterable[str], schema: T.StructType) -> None:
        """A table, or a part of one, that lies under ``out`` already."""
        self.tables[name], self.schemas[name] = list(folders), schema

    def read(self, name: str) -> DataFrame:
        """A table of this refresh, before it is published."""
        return read_folders(self.spark, [f"{self.out}/{f}" for f in self.tables[name]], self.schemas[name])

    def commit(self) -> None:
        """Publish the tables, then clear what neither this refresh nor the former one names."""
        write_text(self.spark, f"{_manifests(self.out, self.as_of)}/{self.version}.json", json.dumps(self.tables, sort_keys=True))
        self._clear()

    def _clear(self) -> None:
        place = _manifests(self.out, self.as_of)
        names = file_names(self.spark, place)
        kept = [json.loads(read_text(self.spark, f"{place}/{n}")) for n in names[-KEEP:]]
        used = {f for tables in kept for folders in tables.values() for f in folders}
        for table in {name for tables in kept for name in tables}:
            date_folder = f"{table}/as_of={self.as_of.isoformat()}"
            if not path_exists(self.spark, f"{self.out}/{date_folder}"):
                continue
            for v in subfolders(self.spark, f"{self.out}/{date_folder}"):
                mine = any(f"{f}/".startswith(f"{date_folder}/{v}/") for f in used)
                if int(v[2:].split("-")[0]) <= int(self.version.split("-")[0]) and not mine:
                    delete_path(self.spark, f"{self.out}/{date_folder}/{v}")
        for n in names[:-KEEP]:
            delete_path(self.spark, f"{place}/{n}")
