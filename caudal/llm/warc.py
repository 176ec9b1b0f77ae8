"""WARC archives: written from page rows, read back by verified boundary chains.

Writing. Each page is one ``WARC/1.0`` record, by Spark's text writer (a
record ends in two line ends, which is the line separator). Pages whose
payload equals that of a page with a smaller id are ``revisit`` records.

Reading. Archives are split wherever Spark splits them, at every occurrence of
the magic line, so a piece may begin at a record or at magic inside a payload.
Each task emits for its pieces the offset of the record that would follow and,
having followed those successors inside its split, the offset at which the
chain leaves the split. Pointer jumping over those exits, from each file's
start, finds the true entries of every split; the records on the chains from
them are real, and everything else is payload. A record whose payload holds
magic is put together from its pieces afterwards; the others are digested
where they were read.

Defined results. A null page text is the empty payload; a null url is left
out. Rows that share the smallest id of a payload are all responses; a null id
counts as larger than any. A file that does not start with the magic line, or
whose chain breaks, yields the records up to the break. An empty table writes
no record and reads back as none. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.tables import written
from caudal.session import shared_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2001-08-01T00:00:00Z"
RECORDS_PER_FILE = 8192
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_ID = "urn:page:"
_M = len(MAGIC)


# -- writing -----------------------------------------------------------------------------


def base32_of_hex(hex40: Column) -> Column:
    """RFC 4648 base32 of a 160-bit digest in hex: each 10 hex digits are 8 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row; payloads of ``min_revisit_bytes`` or more are stored once."""
    shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(url, r"[\r\n]", "%0A").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    first = (rows.filter(F.col("n") >= min_revisit_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("c"))
             .filter("c > 1").select(F.col("sha").alias("_sha"), "first_id").checkpoint())
    rows = counted_join(rows, first, F.col("sha") == F.col("_sha"), "left")
    again = F.col("_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))

    def urn(c: str) -> Column:
        return F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))

    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), urn("first_id"), F.lit(f"WARC-Profile: {PROFILE}")))
         .otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block)
    rows.select(record.alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", records_per_file).text(path)


# -- reading -----------------------------------------------------------------------------


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _split_block(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return _fields(head), payload


def parse_head(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields of the record that begins with ``piece`` (magic line left out), its block's place and length."""
    end = piece.find(b"\r\n\r\n")
    fields = _fields(piece[:end]) if end >= 0 else {}
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not (length.isascii() and length.isdigit()):
        return None
    return fields, end + 4, int(length)


def _describe(fields: dict[str, str], block: bytes) -> tuple:
    """(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest) of a record."""
    kind, (http, payload) = fields["warc-type"], _split_block(block)
    if kind == "revisit":  # the block has the headers only; they tell of the full payload
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines, in order within each split of each file."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("value")))


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, number, place, bytes) of each piece; number and place count from the split's first piece."""
    now, i, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(c) for c in range(3))):
            key = (file.as_py(), block.as_py())
            if key != now:
                now, i, at = key, 0, 0
            piece = value.as_py()
            yield *key, i, at, piece
            i, at = i + 1, at + len(piece) + _M


_INDEX = ("file string, block long, i int, place long, size long, next long, exit long, whole boolean, "
          "record_id string, record_type string, target_uri string, refers_to string, "
          "payload_bytes long, payload_digest string")
_INDEX_NAMES = [f.split(" ")[0] for f in _INDEX.split(", ")]


def _flush(rows: list[list]) -> pa.RecordBatch:
    """Rows of one split, with the place at which the chain from each leaves the split."""
    after = {r[3]: r for r in rows}
    for r in reversed(rows):
        if r[5] is not None:
            r[6] = after[r[5]][6] if r[5] in after and r[5] > r[3] else r[5]
    return pa.RecordBatch.from_pylist([dict(zip(_INDEX_NAMES, r)) for r in rows], schema=_ARROW)


_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("i", pa.int32()), ("place", pa.int64()),
                    ("size", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("whole", pa.bool_()),
                    *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to")),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece: where the record that may begin there would end, and what it would hold."""
    rows, now = [], None
    for file, block, i, place, piece in _enumerated(batches):
        if (file, block) != now and rows:
            yield _flush(rows)
            rows = []
        now = (file, block)
        head = parse_head(piece)
        described, after, whole = (None,) * 6, None, False
        if head:
            fields, start, length = head
            after = place + start + length + len(END) + _M
            whole = start + length + len(END) == len(piece)
            if whole:
                described = _describe(fields, piece[start:start + length])
        rows.append([file, block, i, place, len(piece), after, None, whole, *described])
    if rows:
        yield _flush(rows)


def _reachable_entries(rows: DataFrame) -> DataFrame:
    """(file, place) at which true chains enter a split: pointer jumping over the exits, from each file's start."""
    reach = rows.groupBy("file").agg(F.lit(_M).cast("long").alias("place")).checkpoint()
    goals = rows.select("file", F.col("exit").alias("place")).filter("place IS NOT NULL").distinct()
    jumps = (rows.join(goals.unionByName(reach).distinct(), ["file", "place"], "left_semi")
             .filter("exit IS NOT NULL").select("file", "place", F.col("exit").alias("goal")).distinct().checkpoint())
    while not jumps.isEmpty():
        step = reach.join(jumps, ["file", "place"]).select("file", F.col("goal").alias("place"))
        reach = reach.unionByName(step).distinct().checkpoint()
        onward = jumps.select("file", F.col("place").alias("goal"), F.col("goal").alias("far"))
        jumps = jumps.join(onward, ["file", "goal"]).select("file", "place", F.col("far").alias("goal")).checkpoint()
    return reach


def _follow(split: pd.DataFrame) -> pd.DataFrame:
    """Marks the records on the chains from a split's true entries."""
    after = dict(zip(split["place"], split["next"]))
    real = set()
    for at in split.loc[split["entry"], "place"]:
        while at in after and at not in real:
            real.add(at)
            at = after[at]
    return pd.DataFrame({"file": split["file"], "block": split["block"], "i": split["i"],
                         "real": split["place"].isin(real)})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per true record: where it lies (``file``, ``place`` after its magic line, ``next``) and what it holds."""
    shared_dir(spark)
    raw = _pieces(spark, path).mapInArrow(_candidates, _INDEX).checkpoint()
    # Places count from the split's first piece; a file's splits are summed in order.
    rows = _with_base(raw).withColumns(
        {c: F.col(c) + F.col("base") for c in ("place", "next", "exit")}).drop("base").checkpoint()
    entries = _reachable_entries(rows.select("file", "place", "exit"))
    chain = (rows.select("file", "block", "i", "place", "next")
             .join(entries.withColumn("entry", F.lit(True)), ["file", "place"], "left")
             .withColumn("entry", F.coalesce("entry", F.lit(False)))
             .groupBy("file", "block").applyInPandas(_follow, "file string, block long, i int, real boolean"))
    marked = rows.join(chain, ["file", "block", "i"]).checkpoint()
    real = marked.filter("real AND next IS NOT NULL")
    broken = real.filter("NOT whole")
    if broken.isEmpty():
        return real.drop("block", "i", "size", "exit", "whole", "real")
    return (real.filter("whole").drop("block", "i", "size", "exit", "whole", "real")
            .unionByName(_reassembled(spark, path, marked), allowMissingColumns=False))


def _with_base(pieces: DataFrame) -> DataFrame:
    """``base``: how far into the file the first piece of each split lies, from the sizes of the pieces before it."""
    base = (pieces.groupBy("file", "block").agg(F.sum(F.col("size") + _M).alias("bytes"))
            .withColumn("base", F.expr("sum(bytes) OVER (PARTITION BY file ORDER BY block) - bytes")).drop("bytes"))
    return pieces.join(base, ["file", "block"])


_PIECE = "file string, block long, place long, size long, value binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, _, place, piece in _enumerated(batches):
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "place": [place], "size": [len(piece)], "value": [piece]})


def _reassembled(spark: SparkSession, path: str, marked: DataFrame) -> DataFrame:
    """Records cut by magic inside their payload, put together from their pieces.

    A record's pieces are those up to the next true record, so a group is one
    record's bytes. The files that hold such a record are split anew: Spark
    deals splits by the cores it has at the time, so pieces of two jobs can only
    be told by their place in the file. A record whose pieces do not reach as
    far as its file does fails the job; one that the file itself cuts off is
    none.
    """
    last = marked.groupBy("file").agg(F.max(F.col("place") + F.col("size")).alias("file_end"))
    owner = F.expr("last(CASE WHEN real AND next IS NOT NULL THEN struct(place, next, whole) END, true) "
                   "OVER (PARTITION BY file ORDER BY place)")
    wanted = (marked.withColumn("o", owner).filter("NOT o.whole AND place < o.next").join(last, "file")
              .select("file", F.col("place").alias("at"), F.col("o.place").alias("place"), F.col("o.next").alias("next"), "file_end")
              .checkpoint())
    files = wanted.select("file").distinct()
    cut = written(counted_join(_pieces(spark, path).mapInArrow(_numbered, _PIECE), files, ["file"], "left_semi"))
    pieces = _with_base(cut).select("file", (F.col("place") + F.col("base")).alias("at"), "value")

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        file, place, after, file_end = (t[c][0].as_py() for c in ("file", "place", "next", "file_end"))
        piece = MAGIC.encode().join(t["value"].to_pylist())
        fields, start, length = parse_head(piece) or ({}, 0, len(piece))
        if start + length + len(END) > len(piece):
            if after - _M <= file_end:
                raise ValueError(f"pieces of the record at {place} of {file} are missing")
            return pa.Table.from_pylist([], schema=schema)
        row = [file, place, after, *_describe(fields, piece[start:start + length])]
        return pa.Table.from_pylist([dict(zip(names, row))], schema=schema)

    names = ["file", "place", "next", *_INDEX_NAMES[8:]]
    schema = pa.schema([_ARROW.field(n) for n in names])
    return (counted_join(pieces, wanted, ["file", "at"], "inner").select("file", "place", "next", "file_end", "at", "value")
            .groupBy("file", "place").applyInArrow(build, ", ".join(
                f"{n} {'long' if _ARROW.field(n).type == pa.int64() else 'string'}" for n in names)))


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records written by :func:`write_archives`."""
    def number(c: str) -> Column:
        return F.regexp_extract(c, f"^<{_ID}(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of ``pages`` written under the session's shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/caudal/warc/{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url, html)
    return page_records(read_archives(spark, path))


#: DuckDB statement for the rows of ``round_trip(pages)``.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(s, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM q
"""
