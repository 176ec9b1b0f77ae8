"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a boolean column "this text fails". The cascade is one ``CASE
WHEN`` whose branches are the rules, so a row stops at the first rule that
rejects it; the branches are ordered by rejections per unit of cost, both
measured on a bounded sample. The order changes the cost only: a document is
kept when no rule fails, in whatever order they are asked.

Defined results. A null text is the empty text: no words, rejected by
``few_words``. Repeated rows and repeated ids are judged row by row. Extra
columns, whatever their names, pass through :func:`filter_quality` untouched
because no helper column is ever added. An empty table gives an empty table
(the cascade then keeps the rules' given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 16_384
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain alias may be inlined into every lambda that mentions it and then
    be evaluated per array element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+", -1), "")


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` (one or more of a set) covers."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _lines_with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return _let(_lines_with_word(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def n_repeat_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside a ``k``-word window that the text holds twice or more.

    Windows are compared by a 64-bit hash of their words; neighbours of equal
    hash are compared word by word as well. The sort runs only for texts
    that have a repeated hash at all.
    """
    n = F.size(words)

    def covered(s: Column) -> Column:
        def same(e: Column, other: Column) -> Column:
            return (other["h"] == e["h"]) & (F.slice(words, other["p"] + 1, k) == F.slice(words, e["p"] + 1, k))

        hits = F.filter(F.transform(s, lambda e, j: F.when(same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1)),
                                                           e["p"])),
                        lambda p: p.isNotNull())
        return _let(F.sort_array(hits), lambda ps: F.aggregate(
            F.transform(ps, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(ps, j + 1) - p, F.lit(k)))),
            F.lit(0), lambda a, b: a + b))

    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(n <= k, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered))))


@dataclass(frozen=True)
class Rule:
    """``fails(text, words)`` is true for a text to reject."""

    name: str
    fails: Callable[[Column, Column], Column]


def _shouting(text: Column) -> Column:
    return _let(_count(text, "[A-Z]+"), lambda up: up > _count(text, "[a-z]+"))


#: The contract's two rules, then the method's own; all in whole numbers.
BASE_RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 10),
    Rule("repeated_windows", lambda t, w: 100 * n_repeat_words(w) > 20 * F.size(w)),
)
EXTRA_RULES = (
    Rule("symbols", lambda t, w: 10 * _count(t, _SYMBOLS) > F.size(w)),
    Rule("exclamations", lambda t, w: 2 * _count(t, "!+") > F.size(w)),
    Rule("shouting", lambda t, w: _shouting(t)),
    Rule("duplicate_lines", lambda t, w: _let(
        _lines_with_word(t), lambda ls: 2 * (F.size(ls) - F.size(F.array_distinct(ls))) > F.size(ls))),
    Rule("word_length", lambda t, w: _let(
        F.length(t) - _count(t, _SPACE + "+"),
        lambda chars: (chars > 15 * F.size(w)) | (chars < 2 * F.size(w)))),
)


def _with_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words_of(t), lambda w: body(t, w)))


def cascade(rules: Sequence[Rule]) -> Callable[[Column, Column], Column]:
    """True when some rule rejects; later rules run only on what earlier ones passed."""
    def rejected(text: Column, words: Column) -> Column:
        out = F.when(F.lit(False), F.lit(True))
        for r in rules:
            out = out.when(r.fails(text, words), F.lit(True))
        return out.otherwise(F.lit(False))
    return rejected


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text",
                sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[Rule]:
    """``rules`` by rejections per second, measured on a bounded sample.

    The sample is the first ``sample_rows`` texts of at most ``sample_chars``
    characters (``take`` reads only as many partitions as that needs). Cost is
    the run time of the rule alone over the cached sample (best of two, less
    that of splitting into words); rejection is the share of rows it fails.
    The sample decides the order of evaluation and nothing else.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text)).filter(F.length(text) <= sample_chars).take(sample_rows)
    sample = spark.createDataFrame([(r[0],) for r in texts], "text string").persist()
    try:
        def timed(body: Callable[[Column, Column], Column]) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(2):
                t0 = time.perf_counter()
                hits = sample.agg(F.count_if(_with_words(F.col("text"), body)).alias("n")).first()["n"]
                best = min(best, time.perf_counter() - t0)
            return best, hits

        if not texts:
            return list(rules)
        floor, _ = timed(lambda t, w: F.size(w) < 0)
        rank = {}
        for r in rules:
            cost, hits = timed(r.fails)
            rank[r.name] = hits / max(cost - floor, 1e-3)
        return sorted(rules, key=lambda r: -rank[r.name])
    finally:
        sample.unpersist()


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the base counts, ``base_failed`` and the verdict ``kept``."""
    rejected = cascade(order_rules(docs, EXTRA_RULES, text, sample_rows))

    def metrics(t: Column, w: Column) -> Column:
        def row(n: Column, repeats: Column) -> Column:
            failed = (n < 10) | (100 * repeats > 20 * n)
            return F.struct(
                n.cast("long").alias("n_words"),
                (F.length(t) - _count(t, _SPACE + "+")).cast("long").alias("word_chars"),
                _count(t, _SYMBOLS).cast("long").alias("n_symbols"),
                n_dup_lines(t).cast("long").alias("n_dup_lines"),
                repeats.cast("long").alias("n_repeat_words"),
                failed.alias("base_failed"),
                F.when(failed, F.lit(False)).otherwise(~rejected(t, w)).alias("kept"))
        return _let(n_repeat_words(w), lambda r: row(F.size(w), r))

    m = docs.select(F.col(id_col).alias("doc_id"), _with_words(F.col(text), metrics).alias("m"))
    return m.select("doc_id", "m.*")


def filter_quality(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows that pass every rule, all columns as they were.

    Here the base rules take part in the cascade, so the costly window count
    runs only on rows that the cheaper rules passed.
    """
    rules = order_rules(docs, BASE_RULES + EXTRA_RULES, text, sample_rows)
    return docs.filter(~_with_words(F.col(text), cascade(rules)))


#: DuckDB statement for the rows of ``quality_report(documents)``.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rn, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
hit AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rn, sum(least(5, coalesce(nxt - i, 5))) AS r
  FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM hit) GROUP BY rn),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '!', '', 'g')) AS bangs,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS uppers,
         length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lowers
  FROM d LEFT JOIN rep USING (rn)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * bangs > n_words OR uppers > lowers
            OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
