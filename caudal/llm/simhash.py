"""SimHash near-duplicates by vantage-point trees.

Fingerprints are compared once each: equal ones share a row from the start.
Among 64-bit fingerprints of unrelated texts all distances lie near 32, so a
vantage point alone prunes little at 4 bits (two thirds of the rows straddle
every ball). The forest therefore measures its root level on blocks of bits:
of ``b`` blocks two fingerprints within ``max_bits`` agree on ``b - max_bits``
at least, so in the tree of those blocks the search radius at the root is 0
and every branch but the equal one is pruned. ``b`` grows with the number of
fingerprints, so that shards stay small; the links found are the same. Below the root the trees
use the full Hamming distance: a ball around a vantage point halves the rows,
the triangle bound prunes, and rows whose search ball crosses the boundary
also visit the other side as queries. Leaves compare exactly, so no link is
lost.

Branches of more than ``leaf_rows`` fingerprints (a block value that a third
of all rows may share) are split by distributed vantage points, one level per
round, before any task sees them; a leaf with more queries than that, or a
branch that no level split, is dealt into cells of bounded size. A leaf yields a spanning forest of its
links, never all its pairs; components come from :mod:`caudal.llm.components`.

Defined results. A null or wordless text has fingerprint 0 and is linked like
any other. A null id never becomes a component's id unless the component has
no other. Repeated rows get a row each. An empty table gives an empty result.
Other columns are not read by :func:`near_duplicates`; :func:`keep_one` keeps
them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm.components import components
from caudal.llm.joins import counted_join
from caudal.session import shared_dir

SHINGLE = 4
MAX_BITS = 4
LEAF_ROWS = 16_384
TASK_ROWS = 200_000
SHARD_ROWS = 2048
SEED = 42
_COMPARE = 16  # rows of a leaf

# Byte value to eight 8-bit counters, one per bit.
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


# -- fingerprints ------------------------------------------------------------------------


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each ``k``-word shingle of the text, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, blanks 09-0D and 20
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - k + 1].tolist()
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Bit j of a document is set if it is set in over half of its hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full]).astype("<u8").view(np.uint8).reshape(-1, 8)
    sizes = sizes[full]
    first = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)  # an 8-bit counter holds 255 hashes
    run_first = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    doc_run = np.cumsum(runs) - runs
    bits = np.zeros(len(full), np.uint64)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, byte]], run_first).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), doc_run, axis=0)
        for k in range(8):
            bits |= (2 * counts[:, k] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                      *more: Column) -> DataFrame:
    """(doc_id, fp) and the columns ``more`` for every row."""
    source = docs.select(F.col(text), F.col(id_col).alias("doc_id"), *more)
    schema = T.StructType([*source.schema.fields[1:], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                fps.append(fingerprints([shingle_hashes(t.as_py() or "", shingle) for t in part]))
            fp = np.concatenate(fps).view(np.int64) if fps else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


# -- one leaf ----------------------------------------------------------------------------


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _leaf_links(fps: np.ndarray, home: np.ndarray, query: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what ``home`` forms with itself and with ``query`` within ``r`` bits."""
    near = np.bitwise_count(fps[home][:, None] ^ fps[home][None, :]) <= r
    i, j = np.nonzero(np.triu(near, 1))
    a, b = [home[i]], [home[j]]
    for at in range(0, len(query), 4096):
        part = query[at:at + 4096]
        i, j = np.nonzero(np.bitwise_count(fps[home][:, None] ^ fps[part][None, :]) <= r)
        if len(i) > len(part) + len(home):  # dense: keep a spanning forest of this block
            k = len(home)
            root = local_roots(k + len(part), i, j + k)
            keep = np.flatnonzero(root != np.arange(len(root)))
            nodes = np.concatenate([home, part])
            a.append(nodes[keep]), b.append(nodes[root[keep]])
        else:
            a.append(home[i]), b.append(part[j])
    return np.concatenate(a), np.concatenate(b)


def vantage_links(fps: np.ndarray, home: np.ndarray, query: np.ndarray, r: int = MAX_BITS,
                  compared: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links spanning home-home and home-query pairs within ``r`` bits, by a vantage-point tree over ``home``.

    ``compared`` gets the number of distances taken, to vantage points and in leaves.
    """
    a, b, todo, n = [], [], [(home, query)], 0
    while todo:
        home, query = todo.pop()
        if not len(home) or len(home) + len(query) < 2:
            continue
        if len(home) > _COMPARE:
            v = fps[home[len(home) // 2]]
            dh, dq = np.bitwise_count(fps[home] ^ v), np.bitwise_count(fps[query] ^ v)
            n += len(home) + len(query)
            mu = min(int(np.median(dh)), int(dh.max()) - 1)
            inside = dh <= mu
            if inside.any() and not inside.all():
                left, right = home[inside], home[~inside]
                crossing = right[dh[~inside] <= mu + r]
                todo.append((left, np.concatenate([query[dq <= mu + r], crossing])))
                todo.append((right, query[dq > mu - r]))
                continue
        for at in range(0, len(home), _COMPARE):  # one leaf, or rows a vantage point cannot tell apart
            leaf, rest = home[at:at + _COMPARE], np.concatenate([home[at + _COMPARE:], query])
            n += len(leaf) * (len(leaf) - 1) // 2 + len(leaf) * len(rest)
            x, y = _leaf_links(fps, leaf, rest, r)
            a.append(x), b.append(y)
    if compared is not None:
        compared.append(n)
    return a, b


def _leaves_of_one_shard(fps: np.ndarray, key: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links within shards (runs of equal, sorted ``key``) of no more rows than a leaf, all at once; and the distances taken."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i, lag, n = np.arange(len(key)), 0, 0
    while True:
        lag += 1
        i = i[i + lag < len(key)]
        i = i[key[i] == key[i + lag]]
        if not len(i):
            return np.concatenate(a), np.concatenate(b), n
        n += len(i)
        near = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= r]
        a.append(near), b.append(near + lag)


def _task(r: int):
    """Spanning links of one task's shards: rows (key, fp, home). The first one is a loop and has the distances taken."""
    def run(table: pa.Table) -> pa.Table:
        key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        home = table["home"].to_numpy()
        order = np.lexsort((fp, ~home, key))
        key, fp, home = key[order], fp[order], home[order]
        cut = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = last - first
        single = np.repeat((size <= _COMPARE), size) & np.repeat(np.logical_and.reduceat(home, first), size)
        rows = np.flatnonzero(single)
        i, j, n = _leaves_of_one_shard(fp[rows], key[rows], r)
        a, b, compared = [rows[i]], [rows[j]], [n]
        for s, e in zip(first[~single[first]], last[~single[first]]):
            at = np.arange(s, e)
            x, y = vantage_links(fp, at[home[s:e]], at[~home[s:e]], r, compared)
            a += x
            b += y
        nodes, index = np.unique(fp.view(np.int64), return_inverse=True)
        root = local_roots(len(nodes), index[np.concatenate(a)], index[np.concatenate(b)])
        hit = np.flatnonzero(root != np.arange(len(nodes)))
        counts = np.zeros(len(hit) + 1, np.int64)
        counts[0] = sum(compared)
        return pa.table({"a": np.concatenate([nodes[:1], nodes[hit]]), "b": np.concatenate([nodes[:1], nodes[root[hit]]]),
                         "compared": counts})
    return run


# -- the forest on Spark -------------------------------------------------------------------


def block_edges(blocks: int) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def blocks_for(rows: int, max_bits: int, shard_rows: int = SHARD_ROWS) -> int:
    """How many blocks keep unrelated fingerprints at ``shard_rows`` a shard.

    Of ``b`` blocks at least ``b - max_bits`` agree, so a shard may be keyed by
    that many: more blocks, more key bits, and more trees in the forest.
    """
    b = max_bits + 1
    while b < 2 * max_bits and rows >> sum(sorted(np.diff(block_edges(b)))[:b - max_bits]) > shard_rows:
        b += 1
    return b


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """Array of (agreeing blocks, their bits) keys, one per tree of the forest; any two within ``max_bits`` share one."""
    edges, keys = block_edges(blocks), []
    for tree, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = F.lit(tree).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def _split(big: DataFrame, max_bits: int, leaf_rows: int, levels: int) -> DataFrame:
    """Rows (key, fp, home) of oversized shards, split by distributed vantage points.

    Each round picks a vantage point and the median distance of every node
    that is still too large (a histogram of at most 65 rows a node), and sends
    each row to its side; a row whose search ball crosses the boundary also
    goes to the other side as a query.
    """
    done = []
    for level in range(levels):
        vantage = big.filter("home").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("v"))
        rows = big.join(vantage, "key", "left").withColumn(
            "d", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))).cast("int")).checkpoint()
        done.append(rows.filter(F.coalesce(F.col("n"), F.lit(0)) <= leaf_rows).select("key", "fp", "home"))
        rows = rows.filter(F.col("n") > leaf_rows)
        if rows.isEmpty():
            break
        counts = rows.filter("home").groupBy("key", "n", "d").count()
        ranked = counts.withColumn("below", F.expr("sum(count) OVER (PARTITION BY key ORDER BY d)"))
        mu = ranked.groupBy("key").agg(
            F.least(F.min(F.when(F.col("below") * 2 >= F.col("n"), F.col("d"))), F.max("d") - 1).alias("mu"))
        rows = rows.join(mu, "key")
        inner, outer = F.col("d") <= F.col("mu"), F.col("d") > F.col("mu")
        home = F.col("home")
        left = F.when(home & inner, True).when(F.col("d") <= F.col("mu") + max_bits, False)
        right = F.when(home & outer, True).when(~home & (F.col("d") > F.col("mu") - max_bits), False)
        sides = F.filter(F.array(F.struct(F.lit(0).alias("s"), left.alias("home")),
                                 F.struct(F.lit(1).alias("s"), right.alias("home"))),
                         lambda x: x["home"].isNotNull())
        big = (rows.select("key", "fp", F.explode(sides).alias("x"))
               .select((-F.abs(F.xxhash64("key", "x.s", F.lit(level))) - 1).alias("key"), "fp", F.col("x.home").alias("home")))
    else:
        done.append(big)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _cells(rows: DataFrame, leaf_rows: int) -> DataFrame:
    """``rows`` (key, fp, home) with every key of more than ``leaf_rows`` home or query rows dealt into cells.

    Home and query rows fall into blocks of about ``leaf_rows``; each home
    block meets every later block (and itself) in a cell of its own, as home
    there, so all pairs are compared that the key had.
    """
    blocks = [F.ceil(F.count_if(x) / F.lit(leaf_rows)).cast("int") for x in (F.col("home"), ~F.col("home"))]
    big = (rows.groupBy("key").agg(blocks[0].alias("hb"), blocks[1].alias("qb"))
           .filter((F.col("hb") > 1) | (F.col("qb") > 1)).checkpoint())
    if big.isEmpty():
        return rows
    hb, home, hash_ = F.col("hb"), F.col("home"), F.xxhash64("fp", F.lit(leaf_rows))
    block = F.when(home, F.pmod(hash_, hb)).otherwise(hb + F.pmod(hash_, F.greatest("qb", F.lit(1)))).cast("int")
    wide = counted_join(rows, big, ["key"], "inner").withColumns({"block": block, "last": hb + F.col("qb") - 1})
    block, earlier = F.col("block"), F.least("block", "hb")

    def cell(i: Column, c: Column, is_home: bool) -> Column:
        return F.struct(i.alias("i"), c.alias("c"), F.lit(is_home).alias("home"))

    none = F.filter(F.array(cell(block, block, True)), lambda x: F.lit(False))
    as_home = F.when(home, F.transform(F.sequence(F.least(block + 1, F.col("last")), F.col("last")),
                                       lambda c: cell(block, c, True))).otherwise(none)
    as_query = F.when(earlier > 0, F.transform(F.sequence(F.lit(0), F.greatest(earlier - 1, F.lit(0))),
                                               lambda i: cell(i, block, False))).otherwise(none)
    dealt = (wide.select("key", "fp", F.explode(F.concat(as_home, as_query)).alias("x"))
             .select(F.xxhash64("key", "x.i", "x.c").alias("key"), "fp", F.col("x.home").alias("home")))
    return counted_join(rows, big.select("key"), ["key"], "left_anti").unionByName(dealt)


def links(fps: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, task_rows: int = TASK_ROWS,
          shard_rows: int = SHARD_ROWS, levels: int = 12) -> DataFrame:
    """Edges (a, b) that span every component of distinct fingerprints ``fp`` within ``max_bits`` bits.

    Loops among them; ``compared`` sums up to the distances that were taken.
    """
    blocks = blocks_for(fps.count(), max_bits, shard_rows)
    shards = fps.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("key"), F.lit(True).alias("home"))
    sizes = shards.groupBy("key").count()
    hot = sizes.filter(F.col("count") > leaf_rows).checkpoint()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    small = shards
    if not hot.isEmpty():
        keys = hot.select("key")
        split = _cells(_split(counted_join(shards, keys, ["key"], "left_semi"), max_bits, leaf_rows, levels), leaf_rows)
        total += split.count() - hot.agg(F.sum("count")).first()[0]
        small = counted_join(shards, keys, ["key"], "left_anti").unionByName(split)
    tasks = max(1, -(-total // task_rows))
    grouped = small.select("key", "fp", "home", F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"))
    return grouped.groupBy("task").applyInArrow(_task(max_bits), "a long, b long, compared long")


def _labelled(table: DataFrame, max_bits: int, leaf_rows: int) -> DataFrame:
    """The checkpointed fingerprint table with the ``root`` fingerprint of each row's component."""
    distinct = table.select("fp").distinct()
    roots = components(links(distinct, max_bits, leaf_rows)).select(F.col("node").alias("fp"), "root")
    return table.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row."""
    shared_dir(docs.sparkSession)
    table = fingerprint_table(docs, id_col, text, shingle).checkpoint()
    rows = _labelled(table, max_bits, leaf_rows)
    # Cut here, so that the join has a shuffle of its own and AQE can split a hot component.
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).checkpoint()
    return rows.join(ids, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last).

    Rows are told apart by id and text hash. The rows to drop are joined away
    (by broadcast when they are few, counted first); rows that agree in id and
    text go through one ``dropDuplicates`` of those rows only.
    """
    shared_dir(docs.sparkSession)
    table = fingerprint_table(docs, id_col, text, shingle, F.xxhash64(F.col(text)).alias("hash")).checkpoint()
    rows = _labelled(table, max_bits, leaf_rows)
    rows = rows.groupBy("root", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "hash")).alias("k")).checkpoint()
    rows = rows.join(first, "root").withColumn("keep", F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (
        F.col("hash") == F.col("k.hash")))
    marked = rows.filter(~F.col("keep") | (F.col("n") > 1)).select("doc_id", "hash", "keep").checkpoint()

    def pick(side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
        on = docs[id_col].eqNullSafe(side["_id"]) & (F.xxhash64(docs[text]) == side["_hash"])
        return counted_join(docs, side, on, how)

    out = pick(marked, "left_anti")
    repeated = marked.filter("keep")
    if not repeated.isEmpty():
        out = out.unionByName(pick(repeated, "left_semi").dropDuplicates([id_col, text]))
    return out
