"""Removal of repeated byte passages by a depth-limited radix sort of suffixes.

Every ``window``-byte string of the corpus is a suffix cut at the threshold
depth; equal strings are the repeats, and the first of each group stays. The
radix passes go from the most significant digit down, and a pass only sees
what earlier passes left in groups of two or more:

1. The first digit is an anchor: the ``window / 2``-byte string of smallest
   hash inside the window. Equal windows have equal anchors at equal places,
   and neighbouring windows share theirs, so one row stands for a run of about
   ``window / 4`` windows. Rows are grouped by anchor; the second digit is the
   whole content of the run. In a group of equal runs all but the first are
   repeats, without a look at single windows. Anchors that only one run has
   are done.
2. Runs that share their anchor but not their content (the edges of repeated
   passages) enter the last digit: their single windows, grouped by the whole
   ``window`` bytes. All but the first of a group are repeats. The runs' bytes
   go to the anchor's task, which looks at their windows.

Digits are compared as hashes, by two independent polynomials: 112 bits for
runs, 128 for windows. Whole texts that equal an earlier text are settled
before the passes. Each task first sorts its own rows and forwards one row per
group, so a passage that a third of all documents share costs a row per task.
An anchor with more than ``HOT_RUNS`` different runs in one task is dealt by
run in the first pass and by window in the last, with a marker that tells the
anchor's task to do the same.

Order of documents: id, null last, then text digest. Defined results: a null
text is the empty text; texts shorter than the window lose nothing; of rows
equal in id and text one counts as the earlier. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.packed import pack, plain, squeezed, unpack
from caudal.llm.rolling import BASES, Rolling, mix
from caudal.llm.tables import written
from caudal.session import shared_dir

WINDOW = 100
SEGMENT = 1 << 18
FLUSH_BYTES = 32 << 20
GROUP_BYTES = 8 << 20
HOT_RUNS = 8
_POSITION = np.uint64((1 << 24) - 1)

SPAN, COLD, HOT = 0, 1, 2
_MAP = "bucket long, rows binary, spans binary, extra binary"
_OUT = "kind int, h1 long, doc_id long, seq long, lo long, n long"


# -- rolling hashes ----------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def anchor_runs(data: np.ndarray, ends: np.ndarray, window: int) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, last window, anchor hash, content hash) of texts laid end to end.

    ``ends`` has the end of the text that each byte belongs to. A run is a
    stretch of windows with the same anchor.
    """
    k = window // 2
    none = np.empty(0, np.int64)
    if len(data) < window:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    one, two = Rolling(data, BASES[0]), Rolling(data, BASES[1])
    gram = mix(one.every(k))
    low = _sliding_min((gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64), window - k + 1)
    at = (low & _POSITION).astype(np.int64)  # anchor of each window; ties go to the leftmost
    start = np.arange(len(at))
    valid = start + window <= ends[:len(at)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    hi = np.flatnonzero(last)
    shape = ((at[lo] - lo) * 128 + (hi - lo)).astype(np.uint64)
    content = mix(two(lo, hi + window) ^ mix(shape + np.uint64(1)))
    return lo, hi, gram[at[lo]], content


def window_hashes(data: np.ndarray, starts: np.ndarray, window: int, segment: int = SEGMENT) \
        -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of one text, a segment of it at a time; ``starts`` ascends."""
    h1, h2 = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for s in range(0, max(1, len(data)), segment):
        a, b = np.searchsorted(starts, [s, s + segment])
        if a < b:
            lo = starts[a:b] - s
            part = data[s:s + segment + window - 1]
            for out, base in ((h1, BASES[0]), (h2, BASES[1])):
                out[a:b] = mix(Rolling(part, base)(lo, lo + window))
    return h1, h2


# -- grouping rows -------------------------------------------------------------------------


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order of digits, document and place; which of those have an equal before them)."""
    order = np.lexsort((lo, doc, h2, h1))
    a, b = h1[order], h2[order]
    later = np.zeros(len(order), bool)
    later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, later


def _merge(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``n`` windows from ``lo``, joined where they follow one another in a document."""
    if not len(doc):
        return doc, lo, n
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.add.reduceat(n, first)


def _ranks(null: np.ndarray, ids: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Number of each row's document in document order (equal for rows of one document)."""
    by = np.lexsort((seq, ids, null))
    new = np.zeros(len(by), bool)
    for c in (null, ids, seq):
        new[1:] |= c[by][1:] != c[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


class _Docs:
    """The documents of one flush, and their order."""

    def __init__(self):
        self.ids, self.seqs = [], []

    def add(self, batch: pa.RecordBatch) -> int:
        base = len(self.ids)
        self.ids += batch.column(0).to_pylist()
        self.seqs += batch.column(1).to_pylist()
        return base

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (np.array([i is None for i in self.ids], np.uint8), np.array([i or 0 for i in self.ids], np.int64),
                np.array(self.seqs, np.int64))


def _dealt(buckets: int, *groups: tuple[str, np.ndarray, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that any of the (column, bucket of each row, columns to pack) ``groups`` has rows for."""
    rows: dict[int, dict] = {}
    for name, deal, cols in groups:
        at = (deal % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order])) + 1
        for part in np.split(order, cut) if len(order) else ():
            rows.setdefault(int(at[part[0]]), {})[name] = pack(*(c[part] for c in cols))
    out = [{"bucket": b, **r} for b, r in sorted(rows.items())]
    for i in range(0, len(out), 256):
        yield pa.RecordBatch.from_pylist(out[i:i + 256], schema=pa.schema(
            [("bucket", pa.int64()), *((c, pa.binary()) for c in ("rows", "spans", "extra"))]))


def _first_rows(docs: _Docs, parts: list, buckets: int, hot_runs: int) -> Iterator[pa.RecordBatch]:
    """The runs of one flush: one row per group, spans for the others, markers of anchors with many runs."""
    h1, h2, doc, lo, n = (np.concatenate(x) for x in zip(*parts))
    null, ids, seq = docs.columns()
    order, later = _later(h1, h2, _ranks(null, ids, seq)[doc], lo)
    gone, keep = order[later], np.sort(order[~later])
    sd, sl, sn = _merge(doc[gone], lo[gone], n[gone])
    values, inverse, runs = np.unique(h1[keep], return_inverse=True, return_counts=True)
    hot = (runs > hot_runs)[inverse]
    deal = np.where(hot, mix(h1[keep] ^ mix(h2[keep])), mix(h1[keep]))
    kd = doc[keep]
    marker = values[runs > hot_runs]
    yield from _dealt(
        buckets,
        ("rows", deal, [h1[keep], h2[keep], hot.astype(np.uint8), null[kd], ids[kd], seq[kd], lo[keep], n[keep]]),
        ("spans", mix(sd.astype(np.uint64)), [null[sd], ids[sd], seq[sd], sl, sn]),
        ("extra", mix(marker), [marker]))


def _chunks(batch: pa.RecordBatch, segment: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(row, place, bytes) of the texts of a batch, about ``segment`` bytes at a time; longer texts in overlapping parts."""
    out, size = [], 0
    for row, value in enumerate(batch.column(2)):
        data = np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, max(1, len(data)), segment):
            part = data[at:at + segment + WINDOW - 1]
            out.append((row, at, part))
            size += len(part)
            if size >= segment:
                yield out
                out, size = [], 0
    if out:
        yield out


def _first_digit(buckets: int, hot_runs: int, segment: int, flush_bytes: int):
    """Runs of every text: rows (doc_id, seq, text) to packed rows by anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held = _Docs(), [], 0
        for batch in batches:
            base = docs.add(batch)
            for chunk in _chunks(batch, segment):
                size = np.array([len(p) for _, _, p in chunk])
                stop = np.cumsum(size)
                lo, hi, h1, h2 = anchor_runs(np.concatenate([p for _, _, p in chunk]), np.repeat(stop, size), WINDOW)
                of = np.searchsorted(stop, lo, "right")
                row = np.array([r for r, _, _ in chunk])[of]
                shift = np.array([a for _, a, _ in chunk])[of] - (stop - size)[of]
                # 48 bits tell anchors apart; a chance meeting of two costs a look at their windows, no more.
                parts.append((h1 >> np.uint64(16), h2, row + base, lo + shift, hi - lo + 1))
                held += int(size.sum())
            if held >= flush_bytes:
                yield from _first_rows(docs, parts, buckets, hot_runs)
                docs, parts, held = _Docs(), [], 0
        if parts:
            yield from _first_rows(docs, parts, buckets, hot_runs)
    return run


def _table(kind: np.ndarray, h1: np.ndarray, null: np.ndarray, ids: np.ndarray, seq: np.ndarray, lo: np.ndarray,
           n: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int32()), "h1": pa.array(h1.view(np.int64)),
                     "doc_id": pa.array(ids, mask=null.astype(bool)), "seq": pa.array(seq, pa.int64()),
                     "lo": pa.array(lo), "n": pa.array(n)})


def _group_runs(t: pa.Table) -> pa.Table:
    """One bucket of the first digit: spans of repeats, and the runs that go on (``HOT`` by window, ``COLD`` by anchor)."""
    h1, h2, hot, null, ids, seq, lo, n = unpack(t["rows"].to_pylist(), "QQBBqqqq")
    spans = unpack(t["spans"].to_pylist(), "Bqqqq")
    (marked,) = unpack(t["extra"].to_pylist(), "Q")
    order, later = _later(h1, h2, _ranks(null, ids, seq), lo)
    gone, first = order[later], order[~later]
    a = h1[first]  # ascending
    shared = np.zeros(len(a), bool)
    shared[1:] |= a[1:] == a[:-1]
    shared[:-1] |= a[1:] == a[:-1]
    wide = (hot[first] > 0) | np.isin(a, marked)
    on = first[shared | wide]
    kind = np.where(wide[shared | wide], HOT, COLD)
    none = np.zeros(len(spans[0]) + len(gone), np.int64)
    return _table(np.concatenate([none + SPAN, kind]), np.concatenate([none.view(np.uint64), h1[on]]),
                  *(np.concatenate([s, c[gone], c[on]]) for s, c in zip(spans, (null, ids, seq, lo, n))))


def _last_rows(docs: _Docs, parts: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """The edge runs of one flush: contexts by anchor, and single windows of the hot ones, one row per group."""
    null, ids, seq = docs.columns()
    h1, doc, lo, n, kind, w1, w2, wd, wl = (np.concatenate(x) for x in zip(*(p[:9] for p in parts)))
    data = np.concatenate([p[9] for p in parts])
    cold = np.flatnonzero(kind == COLD)
    order, later = _later(w1, w2, _ranks(null, ids, seq)[wd], wl)
    gone, keep = order[later], order[~later]
    sd, sl, sn = _merge(wd[gone], wl[gone], np.ones(len(gone), np.int64))
    kd = wd[keep]
    yield from _dealt(
        buckets,
        ("rows", mix(w1[keep]), [w1[keep], w2[keep], null[kd], ids[kd], seq[kd], wl[keep]]),
        ("spans", mix(sd.astype(np.uint64)), [null[sd], ids[sd], seq[sd], sl, sn]))
    if len(cold):
        size = n[cold] + WINDOW - 1
        end = np.cumsum(size)
        at = (mix(h1[cold]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(at, kind="stable")
        out = []
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            take = np.repeat((end - size)[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
            c = cold[part]
            d = doc[c]
            out.append({"bucket": int(at[part[0]]), "extra": pack(null[d], ids[d], seq[d], lo[c], n[c], data[take])})
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[i:i + 256], schema=pa.schema(
                [("bucket", pa.int64()), *((c, pa.binary()) for c in ("rows", "spans", "extra"))]))


def _last_digit(buckets: int, segment: int, flush_bytes: int):
    """Edge runs: rows (doc_id, seq, text, runs) to packed contexts and windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held = _Docs(), [], 0
        for batch in batches:
            base = docs.add(batch)
            for row in range(batch.num_rows):
                data = np.frombuffer((batch.column(2)[row].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                runs = batch.column(3)[row].values
                lo, n, h1, kind = (runs.field(i).to_numpy() for i in range(4))
                order = np.argsort(lo)
                lo, n, h1, kind = lo[order], n[order], h1[order].view(np.uint64), kind[order]
                hot, cold = kind == HOT, kind == COLD
                starts = np.repeat(lo[hot] - np.cumsum(n[hot]) + n[hot], n[hot]) + np.arange(n[hot].sum())
                w1, w2 = window_hashes(data, starts, WINDOW, segment)
                size = n[cold] + WINDOW - 1
                take = np.repeat(lo[cold] - np.cumsum(size) + size, size) + np.arange(size.sum())
                me = base + row
                parts.append((h1, np.full(len(lo), me), lo, n, kind, w1, w2, np.full(len(w1), me), starts, data[take]))
                held += 64 * len(w1) + len(take) + 40 * len(lo)
                if held >= flush_bytes:
                    yield from _last_rows(docs, parts, buckets)
                    parts, held = [], 0
        if parts:
            yield from _last_rows(docs, parts, buckets)
    return run


def _group_windows(t: pa.Table) -> pa.Table:
    """One bucket of the last digit: spans of all windows that have an equal before them."""
    w1, w2, null, ids, seq, lo = unpack(t["rows"].to_pylist(), "QQBqqq")
    spans = unpack(t["spans"].to_pylist(), "Bqqqq")
    rnull, rids, rseq, rlo, rn, data = unpack(t["extra"].to_pylist(), "BqqqqB")
    size = rn + WINDOW - 1
    run = np.repeat(np.arange(len(rn)), rn)
    step = np.arange(rn.sum()) - np.repeat(np.cumsum(rn) - rn, rn)
    x1, x2 = window_hashes(data, (np.cumsum(size) - size)[run] + step, WINDOW)
    w1, w2 = np.concatenate([w1, x1]), np.concatenate([w2, x2])
    null, ids, seq = (np.concatenate([a, b[run]]) for a, b in ((null, rnull), (ids, rids), (seq, rseq)))
    lo = np.concatenate([lo, rlo[run] + step])
    rank = _ranks(null, ids, seq)
    order, later = _later(w1, w2, rank, lo)
    gone = order[later]
    doc, glo, gn = _merge(rank[gone], lo[gone], np.ones(len(gone), np.int64))
    of = np.empty(len(rank) and int(rank.max()) + 1, np.int64)
    of[rank] = np.arange(len(rank))
    at = of[doc]
    none = np.zeros(len(spans[0]) + len(doc), np.int64)
    return _table(none + SPAN, none.view(np.uint64),
                  *(np.concatenate([s, c]) for s, c in zip(spans, (null[at], ids[at], seq[at], glo, gn))))


# -- the operator --------------------------------------------------------------------------


def _digest(window: int):
    """Rows (doc_id, text, runs) to the counts and digest of what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not runs.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                lo, n = (runs.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(lo)
                lo, hi = lo[order], np.maximum.accumulate((lo + n + window - 1)[order])
                new = np.ones(len(lo), bool)
                new[1:] = lo[1:] > hi[:-1]
                first = np.flatnonzero(new)
                a, b = lo[first], hi[np.append(first[1:] - 1, len(hi) - 1)]
                kept = hashlib.sha256()
                for s, e in zip([0, *b.tolist()], [*a.tolist(), len(data)]):
                    kept.update(data[s:e])
                out.append((len(data), int((b - a).sum()), len(a), kept.hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _squeeze(docs: DataFrame) -> DataFrame:
    """``text`` (the third column) as zstd bytes ``z``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), squeezed(b.column(2))], names=["doc_id", "seq", "z"])
    return docs.mapInArrow(run, "doc_id long, seq long, z binary")


def _unsqueezed(fn, at: int):
    """``fn`` over batches whose column ``at`` is text again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = pa.array(plain(b.column(at)), pa.string())
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
        yield from fn(texts())
    return run


def _leads(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, seq, text) of the first row of each text, and (doc_id, n_bytes) of the repeats.

    ``seq`` tells apart different texts of one id. Texts shorter than the
    window are all leads.
    """
    rows = docs.select("doc_id", "text", F.unhex(F.sha1(F.col("text"))).alias("sha"))
    narrow = rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")).groupBy(
        "doc_id", "sha", "n_bytes").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")
    many = (narrow.filter(F.col("n_bytes") >= WINDOW).groupBy("sha").agg(F.min(order).alias("o"), F.sum("c").alias("c"))
            .filter("c > 1").select("sha", F.col("o.doc_id").alias("first_id")).checkpoint())
    again = (counted_join(narrow, many, ["sha"], "inner")
             .withColumn("c", F.col("c") - F.col("doc_id").eqNullSafe(F.col("first_id")).cast("long"))
             .filter("c > 0").select("doc_id", "n_bytes", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("x")))
    lead = counted_join(rows, many.select(F.col("sha").alias("_sha"), "first_id"), F.col("sha") == F.col("_sha"), "left")
    lead = lead.filter(F.col("_sha").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", "sha")
    # Rows equal in id and text: one of them is the lead, the others are repeats above.
    twice = narrow.filter((F.col("c") > 1) & (F.col("n_bytes") >= WINDOW)).select(
        F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).checkpoint()
    if not twice.isEmpty():
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
        lead = counted_join(lead, twice, on, "left_anti").unionByName(
            counted_join(lead, twice, on, "left_semi").dropDuplicates(["doc_id", "sha"]))
    # Different texts under one id are told apart by their digest's first 60 bits.
    texts = narrow.select("doc_id", "sha").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    texts = texts.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_many")).checkpoint()
    digest = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    seq = F.when(F.col("_many"), digest).otherwise(F.lit(0).cast("long")).alias("seq")
    return counted_join(lead, texts, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", seq, "text"), again


def _by_document(runs: DataFrame, *fields: str) -> DataFrame:
    """Runs of each document as one array (no longer than the document)."""
    return runs.groupBy(F.col("doc_id").alias("_id"), F.col("seq").alias("_seq")).agg(
        F.collect_list(F.struct("lo", "n", *fields)).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS,
                   group_bytes: int = GROUP_BYTES, segment: int = SEGMENT,
                   flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row.

    A byte goes when a ``WINDOW``-byte string that covers it also starts
    earlier in the corpus as given (overlaps count; what an earlier removal
    leaves is not looked at).
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    leads, again = _leads(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // group_bytes))
    passed = written(leads.mapInArrow(_first_digit(buckets, hot_runs, segment, flush_bytes), _MAP)
                      .groupBy("bucket").applyInArrow(_group_runs, _OUT))
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq"))
    squeezed = _squeeze(leads)
    runs = _by_document(passed.filter(F.col("kind") != SPAN), "h1", "kind")
    edges = squeezed.join(runs, key).select("doc_id", "seq", "z", "runs")
    spans = (edges.mapInArrow(_unsqueezed(_last_digit(buckets, segment, flush_bytes), 2), _MAP)
             .groupBy("bucket").applyInArrow(_group_windows, _OUT).unionByName(passed.filter(F.col("kind") == SPAN)))
    rest = squeezed.join(_by_document(spans), key, "left").select("doc_id", "z", "runs")
    lost = again.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    return rest.mapInArrow(_unsqueezed(_digest(WINDOW), 1), _RESULT).unionByName(lost)
