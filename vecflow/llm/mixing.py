"""Mixing sources to target weights, by hash-threshold histograms.

Sources, in order of code points with null last, weigh 3, 1, 2 and so on again; together
they get ``share`` times the words of all documents. A source's target stops at ``limit``
times its own words, what it leaves goes to the others by weight, until none is above.

A target of e whole passes and a rest takes each document e times; the rest is a budget
for one more copy. Each row has a key, 60 bits of a hash of id and text, and documents
get the extra copy in the order of their keys up to a threshold: a larger budget takes a
superset. The threshold is found by sums of words by source and hash bucket (``BITS`` of
the key): the bucket in which the running sum passes the budget is the only one that is
summed again, by the next bits of its rows' keys, until it holds a single key. Then one
filter marks the rows; rows are never sorted. What the first threshold leaves over (less
than the document at it) is a second, nested budget for the documents behind the
threshold that fit it, so that a very long document at the first threshold costs no
accuracy; taking that document instead is preferred where it comes nearer.

All of it is DataFrame operations. Words are counted once, into a narrow table of id,
source, size and key; histograms hold at most ``2 ** BITS`` rows a source, and a source
with a third of all documents is summed inside each task before any shuffle.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is the
last one; a null id is a value like any other; rows with equal id and text in one source
have one key and are taken alike (where they straddle the budget: nearest); repeated rows
count each; a source without words has target 0; an empty table gives no rows; extra
columns are ignored, whatever their names; texts of any length are counted whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecflow.functions.ids import dense_index
from vecflow.operators.joins import bounded_broadcast, join_key_counts
from vecflow.session import scratch_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: bits of a key, and of one histogram's buckets
KEY_BITS, BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def _matched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys, null equal to null; ``right`` has one row a key and is broadcast if it is small."""
    small, _ = bounded_broadcast(right.withColumnsRenamed({k: f"{k}__r" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys])
    return left.join(small, same).drop(*(f"{k}__r" for k in keys))


def sized_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc, source, size, key) of each document, as a written table."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), body).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    path = scratch_dir(docs.sparkSession, "mixing")
    docs.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{source}`").cast("string").alias("source"),
                F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), key.alias("key")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, docs, source_size, target) of each source."""
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    ranked = dense_index(sums, [F.col("source").asc_nulls_last()], "rank", as_int=False)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("top", limit * F.col("source_size")).checkpoint()
    level, full = 0.0, -1
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("top")
        if full < 0:
            above = F.col("source_size") == 0
        n, taken, rest = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("top"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full:
            break
        full = n
        level = (budget - (taken or 0)) / rest if rest else float("inf")
    open_ = F.col("weight") * F.lit(level) < F.col("top")
    return ranked.select("source", "docs", "source_size", F.when(open_, F.col("weight") * F.lit(level)).otherwise(F.col("top").cast("double")).alias("target"))


def thresholds(pool: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, key, room, over): keys of ``pool`` (source, size, key) below ``key`` fit the budget.

    They leave ``room``; with the rows at ``key`` they are ``over`` the budget. Sources of
    ``budgets`` (source, budget) whose rows fit the budget all have a null key and over.
    """
    shift = KEY_BITS - BITS
    bucket = F.shiftright("key", shift)
    counts = _histogram(pool, bucket).checkpoint()
    fits = _matched(counts, budgets, "source").groupBy("source").agg(F.sum("s").alias("s"), F.first("budget").alias("budget")).where("s <= budget")
    done = [fits.select("source", F.lit(None).cast("long").alias("key"), (F.col("budget") - F.col("s")).alias("room"), F.lit(None).cast("double").alias("over"))]
    while True:
        run = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
        edge = _matched(counts, budgets, "source").withColumn("c", run).where(
            (F.col("c") > F.col("budget")) & (F.col("c") - F.col("s") <= F.col("budget"))).select(
            "source", "bucket", (F.col("budget") - (F.col("c") - F.col("s"))).alias("room"), "s", "lo", "hi").checkpoint()
        done.append(edge.where("lo = hi").select("source", F.col("lo").alias("key"), "room", (F.col("s") - F.col("room")).alias("over")))
        more = edge.where("lo != hi")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        budgets = more.select("source", F.col("room").alias("budget"))
        pool = _matched(pool.withColumn("bucket", bucket), more.select("source", "bucket"), "source", "bucket").select(
            "source", "size", "key").checkpoint()
        shift -= BITS
        bucket = F.shiftright("key", shift)
        counts = _histogram(pool, bucket)


def _histogram(pool: DataFrame, bucket) -> DataFrame:
    return pool.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, text: str = "text", id: str = "doc_id",
        source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each document."""
    sized = sized_documents(docs, text, id, source)
    aims = targets(sized, weights, share, limit)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(0).cast("long")
    aims = aims.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).checkpoint()
    first = thresholds(sized, aims.where("budget > 0").select("source", "budget")).checkpoint()
    behind = _matched(sized, first.select("source", "key", "room").withColumnRenamed("key", "cut"), "source").where(
        (F.col("key") >= F.col("cut")) & (F.col("size") <= F.col("room"))).select("source", "size", "key")
    second = thresholds(behind, first.select("source", F.col("room").alias("budget")).where("budget > 0"))
    cuts = _beside(_beside(aims.drop("budget"), first.withColumnsRenamed({"key": "key1", "over": "over1"})),
                   second.withColumnsRenamed({"key": "key2", "room": "room2", "over": "over2"}))
    # what the second threshold is off; where no document fits the room, all of it
    off = F.coalesce(F.least("room2", "over2"), F.col("room"))
    cuts = cuts.withColumn("wide", F.coalesce(F.col("over1") < off, F.lit(False))).withColumn("last", F.col("over2") < F.col("room2"))
    rows = join_key_counts(sized, cuts, ["source"], "docs")
    key = F.col("key")
    fits = (F.col("size") <= F.col("room")) & (F.col("key2").isNull() | (key < F.col("key2")) | ((key == F.col("key2")) & F.col("last")))
    extra = F.when(F.col("wide"), key <= F.col("key1")).otherwise((key < F.col("key1")) | fits)
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return rows.select(F.col("doc").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, null equal to null; both have one row a source."""
    right = right.withColumnRenamed("source", "source__r")
    return left.join(right, F.col("source").eqNullSafe(F.col("source__r")), "left").drop("source__r")


#: DuckDB SQL for mix() with the default parameters: thresholds by sorting instead
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS place,
         CAST(coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
         CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight,
         CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS total
  FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
v AS (
  SELECT (1.5::DOUBLE * total - full_before) / open_weight AS level
  FROM o WHERE weight * ((1.5::DOUBLE * total - full_before) / open_weight) < 2 * source_size ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         coalesce(CASE WHEN weight * level < 2 * source_size THEN weight * level END, CAST(2 * source_size AS DOUBLE)) AS target
  FROM s LEFT JOIN v ON true),
b AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS BIGINT) AS whole FROM t),
k AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key) AS BIGINT) AS c
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
f AS (
  SELECT *, budget > 0 AND c <= budget AS in_first,
         budget - coalesce(max(CASE WHEN c <= budget THEN c END) OVER (PARTITION BY source), 0) AS room
  FROM k),
g AS (
  SELECT *, CASE WHEN budget > 0 AND NOT in_first AND size <= room THEN size ELSE 0 END AS fill,
         CAST(sum(CASE WHEN budget > 0 AND NOT in_first AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key) AS BIGINT) AS c2,
         CAST(sum(CASE WHEN budget > 0 AND NOT in_first AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source, key) AS BIGINT) AS here
  FROM f),
h AS (
  SELECT *, budget > 0 AND NOT in_first AND size <= room
         AND (c2 <= room OR (c2 - here <= room AND c2 - room < room - (c2 - here))) AS in_second FROM g),
i AS (
  SELECT *, abs(room - CAST(sum(CASE WHEN in_second THEN fill ELSE 0 END) OVER (PARTITION BY source) AS BIGINT)) AS off,
         min(CASE WHEN budget > 0 AND c > budget THEN c - budget END) OVER (PARTITION BY source) AS over1,
         min(CASE WHEN budget > 0 AND c > budget THEN key END) OVER (PARTITION BY source) AS key1
  FROM h)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN budget > 0 AND CASE WHEN over1 < off THEN key <= key1 ELSE in_first OR in_second END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM i"""
