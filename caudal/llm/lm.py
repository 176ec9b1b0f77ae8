"""Language-model scores of documents by stupid backoff over the corpus's own counts.

A word's score after the ``order - 1`` words before it (fewer at a text's
start) is the n-gram's count over its context's count, or where the n-gram is
unknown ``BACKOFF`` times the score after one word less, down to the word's
share of all words. Counts are taken over the whole corpus less the scored
document itself, so that a text is not judged by its own words. A word unknown
to the rest of the corpus counts as ``UNSEEN`` occurrences. ``n_backoff``
counts the words that no n-gram of the full order gave.

The count tables are partitioned by hash range. Documents are dealt into
groups of about ``group_bytes``; a group's n-grams are counted once, joined
with the count table of their range there, and the totals come back to the
group, which sums the logarithms per document. Between the shuffles a group's
n-grams for one range travel as one packed value (n-grams as 64-bit hashes),
so no row per occurrence is ever shuffled and a word that makes up a third of
the corpus costs a row per group.

Words are runs of letters and digits in lower case. Defined results: a null or
wordless text has no words and score 0. Repeated rows are scored row by row
(each sees the others). In a corpus of one document every word is unknown. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.decontaminate import token_hashes
from caudal.llm.packed import pack, plain, squeezed, unpack_one
from caudal.llm.rolling import grams
from caudal.llm.tables import written
from caudal.session import shared_dir

BACKOFF = 0.4
UNSEEN = 0.5
ORDER = 3  # of the registered query
GROUP_BYTES = 8 << 20
RANGE_BYTES = 16 << 20


def _ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(text numbers of the words, for each length up to ``order`` the n-grams' hashes and the places of their last words)."""
    h, of = token_hashes(texts)
    out = [(h, np.arange(len(h)))]
    for m in range(2, order + 1):
        last = np.flatnonzero(of[m - 1:] == of[:1 - m]) + m - 1 if len(h) >= m else np.empty(0, np.int64)
        out.append((grams(h, m)[last - m + 1], last))
    return of, out


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` (under 2^32) equal ranges of 64-bit hashes each falls into; ascends with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _counted(buckets: int, order: int):
    """One group of documents: its distinct n-grams and their counts, a row for each hash range it has any in."""
    def run(t: pa.Table) -> pa.Table:
        of, found = _ngrams(plain(t["z"]), order)
        rows = t["rows"].to_numpy()
        parts: dict[int, list[np.ndarray]] = {}
        for k, (x, last) in zip(range(0, 2 * order, 2), found):
            values, inverse = np.unique(x, return_inverse=True)
            n = np.bincount(inverse, rows[of[last]], len(values))
            at = _ranges(values, buckets)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for part, count in zip(np.split(values, cuts), np.split(n.astype(np.uint64), cuts)):
                if len(part):
                    row = parts.setdefault(int(_ranges(part[:1], buckets)[0]), [np.empty(0, np.uint64), np.empty(0, np.uint64)] * order)
                    row[k:k + 2] = [np.diff(part, prepend=np.uint64(0)), count]
        return pa.table({"g": pa.array([t["g"][0].as_py()] * len(parts), pa.int64()), "bucket": pa.array(list(parts), pa.int64()),
                         "z": pa.array([pack(*row) for row in parts.values()], pa.binary())})
    return run


def _summed(order: int):
    """One hash range: the whole corpus's count of each n-gram, sent back to every group that has it."""
    def run(t: pa.Table) -> pa.Table:
        groups = [unpack_one(z.as_py(), "QQ" * order) for z in t["z"]]
        totals = []
        for k in range(0, 2 * order, 2):
            x = [np.cumsum(g[k], dtype=np.uint64) for g in groups]
            values, inverse = np.unique(np.concatenate(x), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([g[k + 1] for g in groups]), len(values)).astype(np.int64)
            totals.append(np.split(n[inverse], np.cumsum([len(v) for v in x])[:-1]))
        words = [int(g[1].sum(dtype=np.int64)) for g in groups]
        return pa.table({"g": t["g"].combine_chunks(), "bucket": t["bucket"].combine_chunks(),
                         "z": pa.array([pack(*x) for x in zip(*totals)], pa.binary()), "words": pa.array(words, pa.int64())})
    return run


def _own(doc: np.ndarray, gram: np.ndarray, n_grams: int) -> np.ndarray:
    """How often each occurrence's n-gram is in its own document."""
    _, inverse, counts = np.unique(doc * max(n_grams, 1) + gram, return_inverse=True, return_counts=True)
    return counts[inverse]


def _scored(total: int, order: int, backoff: float, unseen: float):
    """One group's documents and the totals of its n-grams, to scores."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        of, found = _ngrams(plain(docs["z"]), order)
        back = [unpack_one(z.as_py(), "q" * order) for z in counts.sort_by("bucket")["z"]]
        size = np.bincount(of, minlength=docs.num_rows)
        rest = np.maximum(total - size, 1)[of]
        for m, (x, last) in enumerate(found):
            values, gram = np.unique(x, return_inverse=True)
            all_ = np.concatenate([np.empty(0, np.int64), *(b[m] for b in back)])
            assert len(values) == len(all_)
            count = np.zeros(len(of), np.int64)
            count[last] = all_[gram] - _own(of[last], gram, len(values))
            if m == 0:
                score, hit = np.log(np.maximum(count, unseen) / rest), last
            else:
                known = count[last] > 0
                hit = last[known]
                score[last[~known]] += np.log(backoff)
                score[hit] = np.log(count[hit] / shorter[hit - 1])
            shorter = count
        unknown = size.copy()
        np.subtract.at(unknown, of[hit], 1)
        sums = np.bincount(of, score, docs.num_rows).astype(np.float64)
        return pa.table({"doc_id": docs["doc_id"].combine_chunks(), "rows": docs["rows"].combine_chunks(),
                         "mean_log_score": sums / np.maximum(size, 1), "n_words": size.astype(np.int64), "log_score": sums,
                         "n_backoff": unknown.astype(np.int64)})
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", backoff: float = BACKOFF,
          unseen: float = UNSEEN, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES,
          order: int = 2) -> DataFrame:
    """(doc_id, mean_log_score, n_words, log_score, n_backoff) per row; natural logarithms.

    Rank by ``mean_log_score``: the sum follows the length.
    """
    if order < 1:
        raise ValueError("order must be 1 at least")
    shared_dir(docs.sparkSession)
    bytes_ = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups, ranges = (max(1, -(-bytes_ // b)) for b in (group_bytes, range_bytes))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rows equal in id and text travel and count as one: their scores are the same.
            same: dict[tuple, int] = {}
            first: list[int] = []
            of = [same.setdefault(key, len(same)) for key in zip(*(b.column(c).to_pylist() for c in (1, 2)))]
            for i, k in enumerate(of):
                if k == len(first):
                    first.append(i)
            b = b.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.bincount(of, minlength=len(first)), pa.int64()), squeezed(b.column(2))],
                names=["g", "doc_id", "rows", "z"])

    # By id and text alone: a group has the same rows however a later job splits the table.
    g = F.pmod(F.xxhash64(F.col(text), F.col(id_col)), F.lit(groups))
    rows = (docs.select(g.alias("g"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(squeeze, "g long, doc_id long, rows long, z binary"))
    counts = written(rows.groupBy("g").applyInArrow(_counted(ranges, order), "g long, bucket long, z binary")
                     .groupBy("bucket").applyInArrow(_summed(order), "g long, bucket long, z binary, words long"))
    total = counts.agg(F.sum("words")).first()[0] or 0
    scored = rows.groupBy("g").cogroup(counts.select("g", "bucket", "z").groupBy("g")).applyInArrow(
        _scored(total, order, backoff, unseen),
        "doc_id long, rows long, mean_log_score double, n_words long, log_score double, n_backoff long")
    # One row per row again, a thousand at a time.
    lots = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / 1000).cast("int")))
    return (scored.withColumn("lot", lots)
            .withColumn("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("rows") - 1000 * F.col("lot")).cast("int"))))
            .drop("rows", "lot", "row"))
