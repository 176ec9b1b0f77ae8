"""WARC round trip, with magic lines and whole records inside payloads."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from caudal.llm import warc


def expected(rows):
    low = {}
    for i, _, h in rows:
        low[h or ""] = min((x for x in (low.get(h or "", i), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        data, first = (h or "").encode(), low[h or ""]
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


FAKE = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""),
        (5, "u", "WARC/1.0\r\n"), (6, "u", "x" + FAKE * 3 + "y"), (7, "u", FAKE), (8, "u", FAKE + FAKE),
        (9, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nabc"), (10, "u", "\r\n\r\n" * 5),
        (11, "u", "WARC/1.0\r\nWARC/1.0\r\nWAWARC/1.0\r\n"), (12, "u", "z" * 20000), (13, "u", FAKE), (None, "u", "no id"),
        *[(i, "u", f"page {i % 37} " * (i % 50)) for i in range(20, 220)]]


@pytest.mark.parametrize("split", ["128m", "3k", "200"])
def test_round_trip(spark, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert got(warc.round_trip(pages(spark, ROWS))) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_small_files(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, ROWS), path, records_per_file=3)
    assert got(warc.page_records(warc.read_archives(spark, path))) == expected(ROWS)


def test_broken_chain_keeps_what_precedes(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record.format(1, 21) + record.format(2, 3) + record.format(3, 21)).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + record.format(4, 21)).encode())
    df = warc.page_records(warc.read_archives(spark, str(tmp_path)))
    assert {r.page_id for r in df.collect()} <= {1, 2}
    assert 1 in {r.page_id for r in df.collect()}


def test_empty_and_clashing_columns(spark):
    df = pages(spark, ROWS).withColumns({"sha": F.lit("x"), "n": F.lit(1), "_sha": F.lit("y"), "value": F.lit(0)})
    assert got(warc.round_trip(df)) == expected(ROWS)
    assert warc.round_trip(df.filter("page_id < 0")).collect() == []


def test_minimum_size_of_revisits(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(pages(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]), path,
                        min_revisit_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.page_records(warc.read_archives(spark, path)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("later", ["300", "64m"])
def test_splits_may_change_between_jobs(spark, tmp_path, later):
    """The cores that Spark has decide its splits; here a setting does, changed once the archive is indexed."""
    rows = [(i, "u", ("x" + FAKE) * (i % 4) + f"page {i} " * (i % 60) if i % 3 == 0 else f"page {i} " * (i % 60)) for i in range(300)]
    path, names = f"{tmp_path}/{uuid.uuid4().hex}", ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    warc.write_archives(pages(spark, rows), path)
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4k" if later == "64m" else "64m")
        records = warc.page_records(warc.read_archives(spark, path))
        for n in names:
            spark.conf.set(n, later)
        assert got(records) == expected(rows)
    finally:
        for n in names:
            spark.conf.set(n, old[n])


def test_missing_pieces_fail(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, ROWS), path)
    whole = warc._numbered
    monkeypatch.setattr(warc, "_numbered", lambda batches: (b for k, b in enumerate(whole(batches)) if k % 5 != 4))
    with pytest.raises(Exception, match="are missing|parse|NoneType"):
        warc.read_archives(spark, path).collect()
