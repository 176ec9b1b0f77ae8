"""Token-id output: documents packed best-fit-decreasing into id matrices.

Documents are cut without loss into pieces of at most ``capacity`` tokens and
dealt by hash into shards of about ``shard_bytes`` of text. In a shard the
pieces are placed longest first, each into the open sequence with the least
room that still takes it; a segment tree over the capacities finds that room
in a logarithm of the capacity. A shard is one task's memory, whatever the
input's size, and wastes less than one sequence.

What is written, as Parquet under the given path, has a row per sequence: its
row of the id matrix (``capacity`` little-endian unsigned ids of 16 bits, 32
for larger vocabularies, padded with 0), the cumulative segment lengths
(``cu_seqlens``, from 0), the places at which positions start again
(``position_resets``) and, per segment, the document, piece and start, so that
every document can be put together again.

Defined results. A null text is the empty text and has the end token alone.
Repeated rows and ids (null ids too) are packed row by row. An empty table
writes no sequence. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm import tokens
from caudal.session import shared_dir

CAPACITY = 4096
SHARD_BYTES = 8 << 20
ROW_GROUP_BYTES = 16 << 20


class RoomTree:
    """Segment tree over free capacities 0 to ``capacity``: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        i = self.leaves + free
        while i:
            self.counts[i] += n
            i >>= 1

    def least_at_least(self, need: int) -> int:
        """The smallest free capacity of ``need`` or more, or -1."""
        counts, i = self.counts, self.leaves + need
        if counts[i]:
            return need
        while i & 1 or not counts[i + 1]:  # up to the first subtree to the right that has some
            i >>= 1
            if i <= 1:
                return -1
        i += 1
        while i < self.leaves:
            i = 2 * i if counts[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences of item numbers; items of ``capacity`` tokens stand alone."""
    rooms, by_room, out = RoomTree(capacity), {}, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        free = rooms.least_at_least(need)
        if free < 0:
            free, seq = capacity, len(out)
            out.append([])
        else:
            seq = by_room[free].pop()
            rooms.add(free, -1)
        out[seq].append(i)
        by_room.setdefault(free - need, []).append(seq)
        rooms.add(free - need, 1)
    return out


def _pieces(path: str, capacity: int, shards: int, kind: str):
    """Rows (doc_id, text) to (shard, doc_id, piece, start, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, ids, shard, size = [], [], [], [], 0
            doc = batch.column(0).to_pylist()

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({
                    "shard": pa.array(shard, pa.int64()), "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array([k * capacity for k in piece], pa.int64()),
                    "ids": pa.array(ids, pa.binary())})

            for i, raw in enumerate(tokens.encode_column(batch.column(1), path)):
                all_ids = np.frombuffer(raw, "<u4").astype(kind).tobytes()
                step = capacity * np.dtype(kind).itemsize
                for k, at in enumerate(range(0, len(all_ids), step)):
                    row.append(i), piece.append(k), ids.append(all_ids[at:at + step])
                    # By id and content: copies go apart, and a rerun of the task deals alike.
                    shard.append(zlib.crc32(ids[-1], zlib.crc32(f"{doc[i]}/{k}".encode())) % shards)
                    size += len(ids[-1])
                if size > 2 << 20:
                    yield flush()
                    row, piece, ids, shard, size = [], [], [], [], 0
            yield flush()
    return run


_FIELDS = [("sequence_id", pa.int64()), ("input_ids", pa.binary()), ("n_tokens", pa.int32()),
           ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
           ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))]
_SCHEMA = ("sequence_id long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
           "doc_ids array<long>, pieces array<int>, starts array<long>")


def _pack_shard(capacity: int, kind: str):
    width = np.dtype(kind).itemsize

    def run(t: pa.Table) -> pa.Table:
        ids = t["ids"].to_pylist()
        doc, piece, start = (t[c].to_pylist() for c in ("doc_id", "piece", "start"))
        shard, rows = t["shard"][0].as_py(), []
        del t
        lengths = np.array([len(x) // width for x in ids], np.int64)
        for s, members in enumerate(best_fit_decreasing(lengths, capacity)):
            ends = np.cumsum(lengths[members]).tolist()
            matrix_row = b"".join([ids[i] for i in members]).ljust(capacity * width, b"\0")
            rows.append((shard << 24 | s, matrix_row, ends[-1], [0, *ends], [0, *ends[:-1]],
                         [doc[i] for i in members], [piece[i] for i in members], [start[i] for i in members]))
        return pa.Table.from_arrays([pa.array(c, f) for c, (_, f) in zip(zip(*rows), _FIELDS)],
                                    names=[n for n, _ in _FIELDS])
    return run


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def write_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                    shard_bytes: int = SHARD_BYTES, tokenizer: str | None = None) -> None:
    """Packed sequences of all ``docs`` as Parquet under ``path``."""
    vocabulary = tokenizer or tokens.default_tokenizer()
    kind = id_type(vocabulary)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    (docs.mapInArrow(_pieces(vocabulary, capacity, shards, kind),
                     "shard long, doc_id long, piece int, start long, ids binary")
     .groupBy("shard").applyInArrow(_pack_shard(capacity, kind), _SCHEMA)
     .write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path))


def read_segments(spark: SparkSession, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every segment, from the written rows.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = []
            for seq, ids, cu, *segments in zip(*(batch.column(c).to_pylist() for c in range(6))):
                row = np.frombuffer(ids, kind[len(ids) // capacity]).astype("<u4")
                for lo, hi, (doc, piece, start) in zip(cu, cu[1:], zip(*segments)):
                    out.append((doc, piece, start, hi - lo, zlib.crc32(row[lo:hi].tobytes()), seq, lo))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows = spark.read.schema(_SCHEMA).parquet(path)
    kind = {2: "<u2", 4: "<u4"}
    return rows.select("sequence_id", "input_ids", "cu_seqlens", "doc_ids", "pieces", "starts").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def written_segments(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` packed into the session's shared folder, and the segments read back from there."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/caudal/tokens/{uuid.uuid4().hex}"
    write_sequences(docs, path, id_col, text)
    return read_segments(spark, path)
