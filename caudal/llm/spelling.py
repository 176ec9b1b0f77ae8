"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

Words are counted over whole texts. Their letter-count vectors differ by one
step up and one down where a letter is replaced, and by one step where one is
inserted or deleted (an L1 distance of two and one). So for each pair of lengths
a range search over a k-d tree of the words of the one length finds all
candidates, a branch is left out when its box lies further up or down from the
word than one edit can reach, and the order of the letters decides.

The upper levels of a length's tree deal its words into cells of about
``cell_words``: a word's home is one cell, and it is sent as a query to every
cell that its search range overlaps. Their splits come from a bounded sample of
the words (``SAMPLE_WORDS``, of at most ``SAMPLE_LETTERS`` letters each) and
decide nothing but the dealing. Each cell is searched by a tree of its own. A
cell that is too large all the same (many words of the same letters cannot be
split) is dealt into a grid of home blocks and query blocks, so that no task
holds more than ``BLOCK_LETTERS`` of either. A cell sends on one row per query:
how many near words, and the best of them.

Each word points to its form, if it has one; pointer jumping finds the roots in
as many rounds as the logarithm of the longest chain (a form is at least twice
as frequent as its word, so chains are short and never closed).

Defined results. A null or empty text has no runs. A null id hashes as the empty
text before the colon. Repeated rows are counted row by row. Of near words of
equal counts the first in code-point order wins. An empty table, or one without
a word that is frequent enough, gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.tables import written

SLIP = 97  # one run in so many loses a letter
MIN_LETTERS = 5
MIN_COUNT = 3
CELL_WORDS = 32_768
LEAF_WORDS = 128
SAMPLE_WORDS = 200_000
SAMPLE_LETTERS = 64
BLOCK_LETTERS = 4 << 20
FLUSH_WORDS = 300_000
FLUSH_LETTERS = 16 << 20

# Latin-1 bytes: lower-cased A-Z, letters as they are, all else a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_DIM = np.zeros(256, np.int64)
_DIM[97:123], _DIM[0xC0:] = np.arange(26), np.arange(26, 90)
DIMS = 90


# -- words ---------------------------------------------------------------------------------


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, as Latin-1 bytes."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def slipped(run: bytes, seed: int, slip: int = SLIP) -> bytes:
    """``run``, less one letter where its hash says so; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(slip: int, least: int):
    def batch_of(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        letters = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs(text.as_py() or "")).items():
                    if len(word) < least:
                        continue
                    word = slipped(word, seed, slip)
                    if len(word) >= least:
                        if word in total:
                            total[word] += n
                        else:
                            total[word] = n
                            letters += len(word)
                if len(total) > FLUSH_WORDS or letters > FLUSH_LETTERS:
                    yield batch_of(total)
                    total, letters = {}, 0
        yield batch_of(total)
    return run


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slip: int = SLIP,
          min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words (Latin-1 bytes) with at least ``min_letters`` letters and ``min_count`` occurrences."""
    rows = docs.select(F.col(id_col), F.col(text)).mapInArrow(_counted(slip, min_letters), "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- trees ---------------------------------------------------------------------------------


def vectors(found: list[bytes]) -> np.ndarray:
    """Letter counts, a row per word."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    letters = _DIM[np.frombuffer(b"".join(found), np.uint8)]
    at = np.repeat(np.arange(len(found)) * DIMS, sizes) + letters
    counts = np.bincount(at, minlength=len(found) * DIMS).reshape(len(found), DIMS)
    return counts.astype(np.int16 if not len(sizes) or sizes.max() < 1 << 14 else np.int32)


def best_split(v: np.ndarray) -> tuple[int, int] | None:
    """(dimension, value) that divides the rows most evenly into up to the value and above; None if all are equal."""
    some = v[::len(v) // 1024] if len(v) > 2048 else v
    for rows in (some, v):
        middle = np.sort(rows, axis=0)[(len(rows) - 1) // 2]
        at = np.concatenate([middle - 1, middle])
        below = np.concatenate([(rows <= middle - 1).sum(0), (rows <= middle).sum(0)])
        uneven = np.where((below > 0) & (below < len(rows)), np.abs(2 * below - len(rows)), np.iinfo(np.int64).max)
        k = int(uneven.argmin())
        if 0 < below[k] < len(rows):
            return k % v.shape[1], int(at[k])
    return None


def grown(v: np.ndarray, leaf_rows: int, leaves: list | None = None, at: np.ndarray | None = None):
    """Tree over rows ``at`` of ``v``: (dimension, value, up to it, above it), or the number of a leaf in ``leaves``."""
    at = np.arange(len(v)) if at is None else at
    split = best_split(v[at]) if len(at) > leaf_rows else None
    if split is None:
        leaves.append(at)
        return len(leaves) - 1
    d, value = split
    low = v[at, d] <= value
    return d, value, grown(v, leaf_rows, leaves, at[low]), grown(v, leaf_rows, leaves, at[~low])


def visited(tree, v: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of ``v``): the leaves whose box each row reaches by ``up`` steps up and ``down`` steps down."""
    stack = [(tree, np.arange(len(v)), up, down, {}, {})]
    while stack:
        node, at, up, down, low, high = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        d, value, below, above = node
        x = v[at, d].astype(np.int64)
        over = np.maximum(x - value, 0) - (np.maximum(x - high[d], 0) if d in high else 0)
        under = np.maximum(value + 1 - x, 0) - (np.maximum(low[d] - x, 0) if d in low else 0)
        go = over <= down
        stack.append((below, at[go], up[go], (down - over)[go], low, {**high, d: value}))
        go = under <= up
        stack.append((above, at[go], (up - under)[go], down[go], {**low, d: value + 1}, high))


# -- search --------------------------------------------------------------------------------


def _matrix(found: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` is one edit from the same row of ``b``; lengths differ by one at most."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    n = short.shape[1]
    front, back = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
    front, back = (np.where(x.all(1), n, x.argmin(1)) for x in (front, back))
    return front + back >= n


def near_words(home: list[bytes], n: np.ndarray, queries: list[bytes],
               leaf_words: int = LEAF_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(near words among ``home``, place of the best of them or -1) of each query.

    ``home`` has words of one length and their counts ``n``; queries are at most
    one letter shorter or longer.
    """
    letters = _matrix(home)
    size = letters.shape[1]
    first = np.lexsort((letters.view(f"S{size}").ravel(), -n))  # best first
    rank = np.empty(len(home), np.int64)
    rank[first] = np.arange(len(home))
    count, best = np.zeros(len(queries), np.int64), np.full(len(queries), len(home), np.int64)
    leaves: list[np.ndarray] = []
    v = vectors(home)
    tree = grown(v, leaf_words, leaves)
    exact = np.float32 if size < 1000 else np.float64
    spread = v.max(0) > 0
    boxes = [(v[at].min(0), v[at].max(0)) for at in leaves]
    # One product gives squared distances: (w, w.w, 1) times (-2 v, 1, v.v), in the letters that home words have.
    v = v[:, spread].astype(exact)
    right = np.concatenate([-2 * v, np.ones((len(v), 1), exact), (v * v).sum(1)[:, None]], axis=1)
    right = [np.ascontiguousarray(right[at].T) for at in leaves]
    by_size = np.fromiter(map(len, queries), np.int64, len(queries))
    for longer in (-1, 0, 1):
        rows = np.flatnonzero(by_size == size + longer)
        if not len(rows):
            continue
        asked = [queries[i] for i in rows.tolist()]
        asked_letters, w = _matrix(asked), vectors(asked)
        square = (w.astype(np.int64) ** 2).sum(1)[:, None]
        left = np.concatenate([w[:, spread], square, np.ones_like(square)], axis=1).astype(exact)
        up, down = (np.full(len(rows), int(x)) for x in (longer <= 0, longer >= 0))
        distance = 2 if longer == 0 else 1  # squared and L1 alike
        for leaf, at in visited(tree, w, up, down):
            lo, hi = boxes[leaf]
            x = w[at]
            at = at[(np.maximum(lo - x, 0).sum(1) <= up[0]) & (np.maximum(x - hi, 0).sum(1) <= down[0])]
            for some in np.array_split(at, len(at) // 16384 + 1):
                q, h = np.nonzero(left[some] @ right[leaf] == distance)
                q, h = some[q], leaves[leaf][h]
                step = max(1, (1 << 22) // size)
                for k in range(0, len(q), step):
                    i, j = q[k:k + step], h[k:k + step]
                    good = one_edit(asked_letters[i], letters[j])
                    i, j = rows[i[good]], j[good]
                    np.add.at(count, i, 1)
                    np.minimum.at(best, i, rank[j])
    return count, np.where(best < len(home), first[np.minimum(best, len(home) - 1)], -1)


# -- dealing -------------------------------------------------------------------------------


def _trees(found: DataFrame, cell_words: int) -> dict[int, tuple]:
    """For each length that needs more cells than one, the tree that deals its words."""
    sizes = {r["size"]: r["c"] for r in found.groupBy(F.octet_length("word").alias("size")).agg(F.count(F.lit(1)).alias("c"))
             .filter((F.col("c") > cell_words) & (F.col("size") <= SAMPLE_LETTERS)).collect()}
    if not sizes:
        return {}
    sample = (found.filter(F.octet_length("word").isin(*sizes)).select("word").orderBy(F.xxhash64("word"), "word")
              .limit(SAMPLE_WORDS).collect())
    by_size: dict[int, list[bytes]] = {}
    for r in sample:
        by_size.setdefault(len(r["word"]), []).append(bytes(r["word"]))
    return {size: grown(vectors(some), max(1, len(some) * cell_words // sizes[size]), []) for size, some in by_size.items()}


def _dealt(trees: dict[int, tuple]):
    """Words to their home cells and to the cells of each length that one edit may reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                v = vectors([found[i] for i in rows.tolist()])
                # (length of the tree, whether at home, steps up and down that the range has)
                for of, home, up, down in ((size, True, 0, 0), (size, False, 1, 1), (size - 1, False, 0, 1), (size + 1, False, 1, 0)):
                    steps = (np.full(len(rows), x) for x in (up, down))
                    for cell, at in visited(trees.get(of, 0), v, *steps):
                        taken = batch.take(pa.array(rows[at]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), of)), pa.array(np.full(len(at), cell)), pa.array(np.full(len(at), home)),
                             taken.column(0), taken.column(1)], names=["size", "cell", "home", "word", "n"])
    return run


def _searched(leaf_words: int):
    """One block of a cell: for each query with a near word there, how many and the best."""
    schema = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        is_home = t["home"].to_numpy()
        home, asked = t.filter(pa.array(is_home)), t.filter(pa.array(~is_home))
        if not home.num_rows or not asked.num_rows:
            return schema.empty_table()
        count, best = near_words(home["word"].to_pylist(), home["n"].to_numpy(), asked["word"].to_pylist(), leaf_words)
        some = np.flatnonzero(count)
        of = home.take(pa.array(best[some]))
        return pa.table([asked["word"].take(pa.array(some)), pa.array(count[some]), of["n"], of["word"]], schema=schema)
    return run


def near(found: DataFrame, cell_words: int = CELL_WORDS, leaf_words: int = LEAF_WORDS,
         block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that are one edit from another.

    ``found`` is read more than once: give it a written table.
    """
    cells = written(found.mapInArrow(_dealt(_trees(found, cell_words)), "size long, cell long, home boolean, word binary, n long"))

    def blocks(home: bool):
        letters = F.sum(F.when(F.col("home") == F.lit(home), F.octet_length("word")))
        return F.ceil(F.coalesce(letters, F.lit(0)) / block_letters).cast("int")

    grid = (cells.groupBy("size", "cell").agg(blocks(True).alias("homes"), blocks(False).alias("asks"))
            .filter("homes > 0 AND asks > 0").checkpoint())
    h = F.xxhash64("word")
    own = F.when(F.col("home"), F.pmod(h, "homes")).otherwise(F.pmod(h, "asks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("asks")).otherwise(F.col("homes")) - 1))
    dealt = (counted_join(cells, grid, ["size", "cell"], "inner").select("*", own.alias("own"), other.alias("other"))
             .select("size", "cell", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("h"),
                     F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("q"), "home", "word", "n"))
    rows = dealt.groupBy("size", "cell", "h", "q").applyInArrow(
        _searched(leaf_words), "word binary, n_near long, best_n long, best binary")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return (rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
            .select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): where the chain of forms from each word ends."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(counted_join(at, onward, ["root"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return at
        at = step.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slip: int = SLIP,
             min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, cell_words: int = CELL_WORDS,
             leaf_words: int = LEAF_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    found = written(words(docs, id_col, text, slip, min_letters, min_count))
    rows = written(found.join(near(found, cell_words, leaf_words, block_letters), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.struct(F.col("best").alias("word"), F.col("best_n").alias("n"))).alias("form")))
    ends = roots(rows.filter("form IS NOT NULL").select("word", F.col("form.word").alias("form")))
    return rows.join(ends, "word", "left").select(
        *(F.decode(c, "ISO-8859-1").alias(name) for c, name in (
            (F.col("word"), "word"), (F.col("form.word"), "form"), (F.coalesce("root", "word"), "root"))),
        "n", "n_near", F.col("form.n").alias("form_n"))
