"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case. A match is a stretch of
at least ``MIN_MATCH`` tokens that a document shares with a benchmark item;
tiling marks the longest matches first, never overlapping, so passages count
whole, in pieces or in another order. A document is contaminated by an item
when the tiles cover at least ``MIN_COVERAGE`` of the item's tokens.

Every match holds a shared run of ``MIN_MATCH`` tokens, a seed. A bitmap of
the benchmark's seeds (2^24 bits at most, whatever the benchmark's size)
travels to the documents; only stretches whose every seed is in the bitmap go
on, as token hashes. They are joined with the benchmark's seeds by hash, pairs
that cannot reach the coverage are dropped (the item's places under shared
seeds bound it), and the rest is tiled by running Karp-Rabin.

Defined results. A null text is the empty text and matches nothing; items of
fewer than ``MIN_MATCH`` tokens match nothing. Repeated rows are judged row by
row; of repeated item ids each row is an item of its own. Empty tables give no
match and drop nothing. :func:`drop_contaminated` keeps extra columns,
whatever their names; nothing else reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.rolling import BASES, Rolling, grams, mix
from caudal.session import shared_dir

MIN_MATCH = 5
MIN_COVERAGE = 0.5
FIRST_LENGTH = 20
BITMAP_BITS = 24
CHUNK = 1 << 20
SEGMENT = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BREAK = 0  # between stretches; no token hashes to it


# -- tokens ------------------------------------------------------------------------------


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all tokens of ``texts``."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    word = _WORD[data]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = np.empty(len(lo), np.uint64)
    i = 0
    while i < len(lo):  # a stretch of about SEGMENT bytes at a time, cut between tokens
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + SEGMENT, "right")))
        h[i:j] = Rolling(data[lo[i]:hi[j - 1]], BASES[0])(lo[i:j] - lo[i], hi[i:j] - lo[i])
        i = j
    h = mix(h ^ mix((hi - lo).astype(np.uint64)))
    stop = np.cumsum([len(p) + 1 for p in parts])
    return np.maximum(h, np.uint64(1)), np.searchsorted(stop, lo, "right")


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``CHUNK`` characters each."""
    first, out, size = 0, [], 0
    for row, value in enumerate(column):
        out.append(value.as_py() or "")
        size += len(out[-1])
        if size >= CHUNK:
            yield first, out
            first, out, size = row + 1, [], 0
    if out:
        yield first, out


def item_tokens(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, tokens) of items long enough to match; ``item`` numbers the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [token_hashes([t.as_py() or ""])[0].view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))],
                                             names=["item_id", "tokens"])

    return (items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("text"))
            .mapInArrow(run, "item_id long, tokens array<long>").filter(F.size("tokens") >= MIN_MATCH)
            .withColumn("item", F.monotonically_increasing_id()).checkpoint())


def seed_table(tokens: DataFrame) -> DataFrame:
    """(item, place, seed) of every run of ``MIN_MATCH`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, row in zip(batch.column(0), batch.column(1)):
                seeds = grams(row.values.to_numpy().view(np.uint64), MIN_MATCH).view(np.int64)
                yield pa.RecordBatch.from_pydict({"item": np.full(len(seeds), item.as_py()),
                                                  "place": np.arange(len(seeds), dtype=np.int32), "seed": seeds})
    return tokens.select("item", "tokens").mapInArrow(run, "item long, place int, seed long").checkpoint()


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Bits by the top of the seeds' hashes, put together on the executors: bounded, since there are
    2^``BITMAP_BITS`` at most."""
    bits = min(BITMAP_BITS, max(16, int(seeds.count()).bit_length() + 7))
    at = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("at"))
    parts = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        out[4096 * r["part"]:4096 * (r["part"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def _stretches(bitmap, bits: int):
    """Rows (id, hash, text) to (doc_id, hash, tokens): the stretches of each text whose every seed is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(bitmap.value, bitorder="little").view(bool)
        for batch in batches:
            rows, found = [], []
            for first, texts in _chunks(batch.column(2)):
                h, of = token_hashes(texts)
                seeds = grams(h, MIN_MATCH)
                hit = have[seeds >> np.uint64(64 - bits)] & (of[:len(seeds)] == of[MIN_MATCH - 1:])
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                inside = np.zeros(len(h) + 1, np.int32)
                np.add.at(inside, at, 1)
                np.add.at(inside, at + MIN_MATCH, -1)
                inside = np.cumsum(inside) > 0
                lo = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]]))
                hi = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
                for s, e in zip(lo, hi):  # a stretch may run over from one text to the next
                    for row in range(of[s], of[e - 1] + 1):
                        part = h[s:e][of[s:e] == row].view(np.int64)
                        if rows and rows[-1] == first + row:
                            found[-1] += [_BREAK, *part.tolist()]
                        else:
                            rows.append(first + row)
                            found.append(part.tolist())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take),
                                              pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "hash", "tokens"])
    return run


# -- tiling ------------------------------------------------------------------------------


def _scan(p: list[int], t: list[int], mp: bytearray, mt: bytearray, s: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal unmarked matches (length, place in p, place in t) of ``s`` or more, and the longest length."""
    mod, base = (1 << 61) - 1, 1_000_003
    top = pow(base, s - 1, mod)

    def hashes(x: list[int], marked: bytearray) -> Iterator[tuple[int, int]]:
        h = run = 0
        for i, v in enumerate(x):
            if marked[i] or v == _BREAK:
                h = run = 0
                continue
            if run >= s:
                h = (h - x[i - s] * top) % mod
            h, run = (h * base + v) % mod, run + 1
            if run >= s:
                yield i - s + 1, h

    table: dict[int, list[int]] = {}
    for j, h in hashes(t, mt):
        table.setdefault(h, []).append(j)
    out, longest = [], 0
    for i, h in hashes(p, mp):
        for j in table.get(h, ()):
            if i and j and not mp[i - 1] and not mt[j - 1] and p[i - 1] == t[j - 1]:
                continue  # part of the match that begins one earlier
            k = 0
            while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                k += 1
            if k >= s:
                out.append((k, i, j))
                longest = max(longest, k)
    return out, longest


def tile(p: list[int], t: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (length, place in p, place in t): longest first, ties by place, none overlapping."""
    mp, mt, tiles = bytearray(len(p)), bytearray(len(t)), []
    s = max(min_match, FIRST_LENGTH)
    while True:
        matches, longest = _scan(p, t, mp, mt, s) if s <= min(len(p), len(t)) else ([], 0)
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-k, i, j) for k, i, j in matches]
        heapify(queue)
        while queue:
            k, i, j = heappop(queue)
            k = -k
            if not any(mp[i:i + k]) and not any(mt[j:j + k]):
                mp[i:i + k] = mt[j:j + k] = b"\x01" * k
                tiles.append((k, i, j))
                continue
            begin = None  # what longer tiles left of it waits for its turn; what is shorter than s, for a later scan
            for x in range(k + 1):
                if x < k and not mp[i + x] and not mt[j + x]:
                    begin = x if begin is None else begin
                elif begin is not None:
                    if x - begin >= s:
                        heappush(queue, (begin - x, i + begin, j + begin))
                    begin = None
        if s <= min_match:
            return tiles
        s = max(min_match, s // 2)


def _enough(p: list[int], t: list[int], min_coverage: float) -> bool:
    """Whether the places of ``p`` whose seeds ``t`` has could cover enough: ``MIN_MATCH`` tokens each, at most."""
    x, y = (np.array(v, np.int64).view(np.uint64) for v in (p, t))
    have = np.isin(grams(x, MIN_MATCH), grams(y, MIN_MATCH))
    return int(have.sum()) * MIN_MATCH >= min_coverage * len(p)


def _tiled(min_coverage: float):
    """Rows (doc_id, hash, item_id, item tokens, tokens) of candidate pairs to those that reach the coverage."""
    names = ["doc_id", "hash", "item_id", "item_tokens", "covered_tokens", "n_tiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, covered, counts = [], [], [], []
            for row in range(batch.num_rows):
                p, t = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
                if not _enough(p, t, min_coverage):
                    continue
                tiles = tile(p, t)
                n = sum(k for k, _, _ in tiles)
                if n >= min_coverage * len(p):
                    keep.append(row), sizes.append(len(p)), covered.append(n), counts.append(len(tiles))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)),
                                              *(pa.array(x, pa.int64()) for x in (sizes, covered, counts))], names=names)
    return run


# -- the operator --------------------------------------------------------------------------


def _seeds_of(found: DataFrame) -> DataFrame:
    """(row, seed) of the seeds in each row's stretches, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tokens in zip(batch.column(0), batch.column(1)):
                x = tokens.values.to_numpy().view(np.uint64)
                whole = np.ones(max(0, len(x) - MIN_MATCH + 1), bool)
                for at in np.flatnonzero(x == _BREAK):
                    whole[max(0, at - MIN_MATCH + 1):at + 1] = False
                seed = np.unique(grams(x, MIN_MATCH)[whole]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"row": np.full(len(seed), row.as_py()), "seed": seed})
    return found.select("row", "tokens").mapInArrow(run, "row long, seed long")


def shared_seeds(found: DataFrame, tokens: DataFrame, seeds: DataFrame, min_coverage: float) -> DataFrame:
    """(row, item) for each shared seed that decides a candidate pair; every pair that could reach the coverage has one.

    An item with m places needs ``need`` of them shared, so a row that shares
    none of its m - need + 1 rarest cannot reach the coverage. The commonest
    ones, such as a phrase that many items and documents hold, are not joined.
    """
    hits = _seeds_of(found)
    often = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("rows"))
    need = F.greatest(F.ceil(F.lit(min_coverage) * F.size("tokens") / MIN_MATCH), F.lit(1))
    sizes = tokens.select("item", (F.size("tokens") - MIN_MATCH + 2 - need).alias("taken"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("rows", F.lit(0)), "seed", "place")
    taken = (seeds.join(often, "seed", "left").join(sizes, "item").withColumn("rank", F.row_number().over(rarest))
             .filter("rank <= taken").select("item", "seed").distinct())
    return hits.join(taken, "seed").select("row", "item")


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                       min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, hash, item_id, item_tokens, covered_tokens, n_tiles) per contaminated row and item.

    ``hash`` is the text's XXH64, which with the id names the row.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    tokens = item_tokens(items)
    seeds = seed_table(tokens)
    packed, bits = _bitmap(seeds)
    bitmap = spark.sparkContext.broadcast(packed)
    found = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text))
             .mapInArrow(_stretches(bitmap, bits), "doc_id long, hash long, tokens array<long>")
             .withColumn("row", F.monotonically_increasing_id()).checkpoint())
    bitmap.unpersist()
    pairs = shared_seeds(found, tokens, seeds, min_coverage).distinct()
    rows = (pairs.join(tokens.withColumnRenamed("tokens", "p"), "item").join(found.withColumnRenamed("tokens", "t"), "row")
            .select("doc_id", "hash", "item_id", "p", "t"))
    return rows.mapInArrow(_tiled(min_coverage), "doc_id long, hash long, item_id long, item_tokens long, "
                                                 "covered_tokens long, n_tiles long")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                      min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without the rows that any item contaminates."""
    bad = (contaminated_pairs(docs, items, id_col, text, min_coverage)
           .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct().checkpoint())
    on = docs[id_col].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_hash"])
    return counted_join(docs, bad, on, "left_anti")
