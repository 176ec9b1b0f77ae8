"""Exact deduplication by deterministic block naming, in DataFrame functions only.

A text (runs of white space as one blank) is cut into blocks of ``block_bytes``
bytes, the last one shorter. The blocks that occur twice or more are sorted and
named by integers in that order. Adjacent names are paired, the pairs sorted and
named in turn, and so on until a document has one name. A name stands for one
sequence of blocks, so equal names of one level mean equal texts: nothing is
decided by a hash. A document with a block or pair that occurs nowhere else is
alone and leaves at that level, so the higher levels hold documents that still
agree with others, at half the names each.

Names are joined to the occurrences (never gathered per block), so a block, a
passage or a text that a third of the rows hold costs one row after partial
aggregation, and AQE splits its side of the join. Each level is a table in the
session's shared folder. A document's names, eight bytes for each block, travel
as one array.

Defined results. A null text is the empty one: a single empty block, equal to
any other empty text; a text of white space only is one blank. Of rows that
share the smallest id and text, one is kept, whichever. A null id counts as
larger than any. An empty table gives an empty result. Extra columns are not
read. Any id type that orders will do; its type is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.tables import written

BLOCK_BYTES = 1024
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _cut(text: Column, block_bytes: int) -> Column:
    """(sha, blocks) of a text, which is normalised once: the lambda binds it."""
    def parts(t: Column) -> Column:
        data = t.cast("binary")
        last = F.greatest(F.floor((F.octet_length(t) - 1) / block_bytes), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last),
                             lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))
        return F.struct(F.sha2(data, 256).alias("sha"), blocks.alias("parts"))
    return F.transform(F.array(normalised(text)), parts)[0]


def _names(keys: DataFrame) -> DataFrame:
    """An integer for every key that occurs twice or more, in the order of the keys."""
    again = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return written(again.orderBy(*keys.columns).withColumn("name", F.monotonically_increasing_id()))


def _renamed(each: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, sha, names): the names of a document's parts in order, null where one has none."""
    keys = [c for c in names.columns if c != "name"]
    found = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return written(each.join(names, keys, "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
        F.when(F.count("name") == F.count(F.lit(1)), found).alias("names")))


def _exploded(rows: DataFrame, parts: Column) -> DataFrame:
    """One row per part; the id and the digest travel with the first one."""
    first = F.col("pos") == 0
    return (rows.select("rid", "doc_id", "sha", F.posexplode(parts).alias("pos", "part"))
            .select("rid", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"),
                    "pos", "part"))


def _pairs() -> Column:
    """Adjacent names; the last one of an odd number goes with -1."""
    half = F.floor((F.size("names") - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half), lambda i: F.struct(
        F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))


def named(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, sha, level, name) per row; name is null where the text is no other row's.

    ``rid`` numbers the rows, ``sha`` is the digest of the normalised text in
    hex, and (level, name) is its identity.
    """
    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("m", _cut(F.col(text), block_bytes))

    names = _names(blocks(docs).select(F.explode("m.parts").alias("part")))
    rows = blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text)).withColumn("rid", F.monotonically_increasing_id()))
    rows = _renamed(_exploded(rows.select("rid", "doc_id", F.col("m.sha").alias("sha"), F.col("m.parts").alias("parts")),
                              F.col("parts")), names)
    done, level = [], 0
    while True:
        size = F.size("names")
        done.append(rows.filter(F.col("names").isNull() | (size == 1)).select(
            "rid", "doc_id", "sha", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("name")))
        rows, level = rows.filter(size > 1), level + 1
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        each = _exploded(rows, _pairs()).select("rid", "doc_id", "sha", "pos", "part.a", "part.b")
        rows = _renamed(each, _names(each.select("a", "b")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row, dropped ones too."""
    rows = named(docs, id_col, text, block_bytes)
    alone, shared = rows.filter("name IS NULL"), rows.filter("name IS NOT NULL")
    # A name can outlive its only document: blocks repeat within one text.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    groups = written(shared.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size")))
    out = counted_join(shared, groups, ["level", "name"], "inner").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"))
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))


#: DuckDB statement for the rows of ``deduplicate(documents)``.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS c FROM d)
SELECT doc_id, keep_id, CAST(c AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
