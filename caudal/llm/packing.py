"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut); pieces of exactly ``capacity`` fill a sequence alone. The others are
dealt by hash into shards of about ``shard_items`` pieces. Each shard is
solved on several islands: an island evolves a small population of whole
packings, where crossover injects well-filled bins of one parent into the
other, drops the bins that now hold a piece twice and best-fits the displaced
pieces; it goes on past the fewest possible bins for as long as the slack is not
all in one of them. Between epochs the islands' elites migrate to the next island of the
same shard. Bins that the best island leaves with room go to the next level,
where the rooms of many shards are pooled and packed again.

A task holds the pieces of one shard only (an id and a length each), whatever
the input's size; every level and epoch is cut by a checkpoint in the
session's checkpoint folder.

Defined results. A null text is the empty text and has the end token alone.
Rows are packed one by one, so repeated rows and ids all get their place. An
empty table packs into an empty table. Extra columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm import tokens
from caudal.session import shared_dir

CAPACITY = 4096
SHARD_ITEMS = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
LEVELS = 4
WELL_FILLED = 0.995

Bin = list[int]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, in row order."""
    path = tokenizer or tokens.default_tokenizer()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens.encode_column(batch.column(1), path)):
                view = memoryview(ids)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = view[at:at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


# -- one shard ---------------------------------------------------------------------------


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: list[Bin], free: list[int]) -> None:
    """Put each item into the fullest bin that takes it, opening bins where none does (in place).

    ``rooms`` has the bins by free space; bit f of ``have`` says that some bin has f free.
    """
    rooms: dict[int, list[int]] = {}
    have = 0
    for b, f in enumerate(free):
        rooms.setdefault(f, []).append(b)
        have |= 1 << f
    for i in items:
        need = lengths[i]
        fits = have >> need
        if fits:
            f = need + (fits & -fits).bit_length() - 1
            b = rooms[f].pop()
            if not rooms[f]:
                have ^= 1 << f
        else:
            f, b = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[b] = [*bins[b], i]  # a new list: packings share their bins
        free[b] = f - need
        rooms.setdefault(f - need, []).append(b)
        have |= 1 << (f - need)


def _fills(bins: list[Bin], lengths: list[int]) -> list[int]:
    return [sum([lengths[i] for i in x]) for x in bins]


def _refit(kept: list[Bin], loose: list[int], lengths: list[int], capacity: int) -> list[Bin]:
    """``kept`` with the ``loose`` items best-fitted, longest first."""
    loose = sorted(loose, key=lambda i: -lengths[i])
    best_fit(loose, lengths, capacity, kept, [capacity - f for f in _fills(kept, lengths)])
    return kept


def crossover(a: list[Bin], b: list[Bin], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Whole well-filled bins of ``b`` injected into ``a``; duplicates go, displaced items are best-fitted.

    The bins come from the better-filled half of ``b``, a sixteenth of it: more
    would displace most of ``a``, which then is not inherited but packed anew.
    """
    fills = _fills(b, lengths)
    top = sorted(range(len(b)), key=lambda k: -fills[k])[:max(1, len(b) // 2)]
    injected = [b[k] for k in rng.sample(top, max(1, len(top) // 16))]
    taken = {i for x in injected for i in x}
    bins, displaced = injected, []
    for x in a:
        if taken.isdisjoint(x):
            bins.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    return _refit(bins, displaced, lengths, capacity)


def mutate(bins: list[Bin], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """The emptiest bins and a few others dissolved and best-fitted again."""
    fills = _fills(bins, lengths)
    ranked = sorted(range(len(bins)), key=lambda k: fills[k])
    n = max(2, len(ranked) // 50)
    gone = set(ranked[:n]) | {rng.randrange(len(ranked)) for _ in range(n)}
    return _refit([x for k, x in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]], lengths, capacity)


def _fitness(bins: list[Bin], lengths: list[int], capacity: int) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (sum of squared fills)."""
    return len(bins), -sum([f * f for f in _fills(bins, lengths)])


def evolve(lengths: list[int], capacity: int, seeds: list[list[Bin]], rng: random.Random,
           population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[Bin], int]:
    """The best packing found, and the number of crossovers.

    Stops only at what cannot be better: as few bins as the total length
    allows, all full but one. Until then fuller bins count, so that the slack
    gathers in few bins, which the next level pools.
    """
    full, rest = divmod(sum(lengths), capacity)
    ideal = full + (rest > 0), -(full * capacity * capacity + rest * rest)
    score = lambda x: _fitness(x, lengths, capacity)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    pool = [(score(s), s) for s in seeds]
    while len(pool) < population and min((f for f, _ in pool), default=None) != ideal:
        spread = (0.05, 0.0005)[len(pool) % 2]
        order = down if not pool else sorted(down, key=lambda i: -lengths[i] * rng.uniform(1.0 - spread, 1.0))
        bins: list[Bin] = []
        best_fit(order, lengths, capacity, bins, [])
        pool.append((score(bins), bins))
    pool.sort(key=lambda x: x[0])
    crossed = 0
    for _ in range(generations):
        if pool[0][0] == ideal or len(pool) < 2:
            break
        a, b = sorted(rng.sample(range(len(pool)), 2))
        children = [crossover(pool[a][1], pool[b][1], lengths, capacity, rng),
                    crossover(pool[b][1], pool[a][1], lengths, capacity, rng), mutate(pool[0][1], lengths, capacity, rng)]
        crossed += 2
        pool = sorted(pool + [(score(x), x) for x in children], key=lambda x: x[0])[:population]
    return pool[0][1], crossed


# -- islands and levels on Spark -----------------------------------------------------------

# ``crossed``: the island's crossovers so far, with its first piece (0 with the others).
_STATE = "shard long, island int, uid long, length long, bin long, migrant long, crossed long"


def _epoch(capacity: int, epoch: int):
    """Evolve one island of one shard from its own elite and the migrant one."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        lengths, seeds = t["length"].to_pylist(), []
        for column in ("bin", "migrant"):
            of = t[column].to_pylist()
            if of[0] >= 0:
                bins: list[Bin] = [[] for _ in range(max(of) + 1)]
                for i, b in enumerate(of):
                    bins[b].append(i)
                seeds.append(bins)
        rng = random.Random(f"{t['shard'][0]}/{t['island'][0]}/{epoch}")
        where = [0] * len(lengths)
        bins, crossed = evolve(lengths, capacity, seeds, rng)
        for b, members in enumerate(bins):
            for i in members:
                where[i] = b
        before = sum(t["crossed"].to_pylist())
        return (t.select(["shard", "island", "uid", "length"]).append_column("bin", pa.array(where, pa.int64()))
                .append_column("migrant", pa.array([-1] * len(where), pa.int64()))
                .append_column("crossed", pa.array([before + crossed] + [0] * (len(where) - 1), pa.int64())))
    return run


def _solve(pieces: DataFrame, shards: int, capacity: int, level: int, report: dict[str, int] | None) -> DataFrame:
    """(shard, uid, length, bin) of the best island of each shard: fewest bins, then fullest.

    ``report`` gets the crossovers of all islands added.
    """
    state = (pieces.select("uid", "length")
             .withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
             .withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
             .select("shard", "island", "uid", "length", F.lit(-1).cast("long").alias("bin"),
                     F.lit(-1).cast("long").alias("migrant"), F.lit(0).cast("long").alias("crossed")))
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("shard", "uid", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                 F.col("bin").alias("migrant"))
            state = state.drop("migrant").join(elite, ["shard", "uid", "island"]).select(
                "shard", "island", "uid", "length", "bin", "migrant", "crossed")
        state = state.groupBy("shard", "island").applyInArrow(_epoch(capacity, epoch), _STATE).checkpoint()
    if report is not None:
        report["crossovers"] = report.get("crossovers", 0) + (state.agg(F.sum("crossed")).first()[0] or 0)
    fills = state.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    best = (fills.groupBy("shard", "island").agg(F.max("bin").alias("last"), (-F.sum(F.col("fill") * F.col("fill"))).alias("loose"))
            .groupBy("shard").agg(F.min(F.struct("last", "loose", "island")).alias("b"))
            .select("shard", F.col("b.island").alias("island")))
    return state.join(best, ["shard", "island"]).select("shard", "uid", "length", "bin")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS,
         report: dict[str, int] | None = None) -> DataFrame:
    """``pieces`` (uid, length, ...) with ``sequence_id`` and ``offset``; ``report`` gets the number of crossovers.

    ``uid`` must be unique and ``pieces`` stable when read again (a written
    table or a checkpoint).
    """
    spark = pieces.sparkSession
    shared_dir(spark)
    full = pieces.filter(F.col("length") >= capacity).select("uid", (F.col("uid") * 2 + 1).alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("uid", "length")
    placed = [full]
    left = rest.count()
    for level in range(LEVELS):
        if not left:
            break
        shards = -(-left // shard_items)
        last = shards == 1 or level == LEVELS - 1
        solved = _solve(rest, shards, capacity, level, report)
        # A bin has at most `capacity` pieces, so this window is bounded.
        by_bin = "PARTITION BY shard, bin"
        solved = solved.withColumns({
            "fill": F.expr(f"sum(length) OVER ({by_bin})"),
            "offset": F.expr(f"sum(length) OVER ({by_bin} ORDER BY uid) - length")}).checkpoint()
        done = solved if last else solved.filter(F.col("fill") >= WELL_FILLED * capacity)
        # Level, shard and bin make the number: 2 + 40 + 20 bits, even (full pieces are odd).
        number = ((F.lit(level).cast("long") * (1 << 40) + F.col("shard")) * (1 << 20) + F.col("bin")) * 2
        placed.append(done.select("uid", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = solved.filter(F.col("fill") < WELL_FILLED * capacity).select("uid", "length")
        left = rest.count()
    seats = placed[0]
    for p in placed[1:]:
        seats = seats.unionByName(p)
    return pieces.join(seats, "uid")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   shard_items: int = SHARD_ITEMS, tokenizer: str | None = None,
                   report: dict[str, int] | None = None) -> DataFrame:
    """Place of every piece of every document: tokenised once, then packed by length alone."""
    shared_dir(docs.sparkSession)
    pieces = (token_pieces(docs, id_col, text, capacity, tokenizer)
              .withColumn("uid", F.monotonically_increasing_id()).checkpoint())
    return pack(pieces, capacity, shard_items, report).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
