"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct shingle sets (documents with equal sets
form one class), columns are shingle hashes. Overlaps are products of rows, and
size-derived bounds discard pairs early:

* sizes alone: overlap >= t * union needs the smaller set to be >= t times the larger;
* a prefix of the columns: with all columns in one fixed order, two sets that meet the
  threshold share a column among the first n - ceil(t n) + 1 of each. Only those
  incidences are shuffled. Any order is exact; frequent shingles go last, by a sketch
  of the counts whose size is fixed, so that common passages rarely bring documents
  together.

Rows that share a prefix column meet in one sorted stream per column. Each row is first
paired with the column's first row alone, the one with the fewest columns before this one
(the least altered of a group of near copies); pairs' overlaps in the prefix columns are
counted, and the bound that sizes put on that count discards most of them. The verified
links give components, and only rows that are still in different components are paired
further: where a column can be the first that two rows share (all columns before it are
missing in the other), and where their complete prefix overlap passes the bound. Nothing
is lost: a pair that meets the threshold is either verified itself or already connected. Candidates are verified exactly, in blocks
of one row against up to ``BLOCK`` others (the block product accumulates the overlap over
all columns, the bound on the union discards).

Shingles and sets are told apart by 64-bit hashes.

Defined cases: a null or wordless text has an empty set and is linked with nothing; fewer
than five words are one shingle; repeated rows and copies share a class; a null doc_id
takes the component of its class, and counts as no candidate for the smallest id; an
empty table gives no rows; extra columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import _GOLDEN, as_bytes, hashed_texts, input_partitions, mix64, summed_blocks
from vecflow.llm.components import components
from vecflow.session import scratch_dir

WORDS = 5
#: threshold as a whole number of hundredths, so that the comparison is exact
PERCENT = 75
#: cells of the count sketch, whatever the data's size
SKETCH_BITS = 21
#: cells of the filter of candidate sets, whatever the data's size
FILTER_BITS = 22
#: rows that one row is multiplied with at a time
BLOCK = 512
_TOP = np.uint64(1 << 63)
_K = np.cumprod(np.full(64, 0xD1342543DE82EF95, dtype=np.uint64), dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words (of all words if there are fewer), in text order."""
    n = len(words)
    if not n:
        return words
    m = min(size, n)
    acc = np.full(n - m + 1, m * int(_GOLDEN) & (1 << 64) - 1, dtype=np.uint64)
    for i in range(m):
        acc += words[i:n - m + 1 + i] * _K[i]
    return mix64(acc)


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Order class of each sketch cell: half powers of two of the shingles counted in it."""
    def count(batches):
        acc, kept, held = np.zeros(1 << SKETCH_BITS, dtype=np.int64), [], 0
        for b in batches:
            for _, words in hashed_texts(as_bytes(b.column(0))):
                kept.append(shingle_hashes(words, size) >> np.uint64(64 - SKETCH_BITS))
                held += len(kept[-1])
                if held > 1 << 20:
                    acc += np.bincount(np.concatenate(kept).astype(np.int64), minlength=len(acc))
                    kept, held = [], 0
        if held:
            acc += np.bincount(np.concatenate(kept).astype(np.int64), minlength=len(acc))
        return acc

    counts = summed_blocks(texts, count, 1 << SKETCH_BITS)
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def _ordered(u: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, its order classes) of a set's rising hashes: rare classes first, then by hash."""
    of = rank[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    first = np.argsort(of, kind="stable")[:prefix_length(len(u), percent)]
    return u[first], of[first]


def set_key(u: np.ndarray) -> int:
    """64-bit key of a set of hashes, signed as Spark's long."""
    k = xxhash.xxh3_64_intdigest(u.tobytes())
    return k - (1 << 64) if k >> 63 else k


def _sets(docs: DataFrame, id: str, text: str, size: int, percent: int, order) -> DataFrame:
    """(doc, text_hash, n, key, last_class, last): size and key of each set, and the last incidence of its prefix."""
    def run(batches):
        rank = order.value
        for b in batches:
            cols = [[] for _ in range(4)]
            for _, words in hashed_texts(as_bytes(b.column(1))):
                u = np.unique(shingle_hashes(words, size))
                row = (0, None, None, None)
                if len(u):
                    prefix, of = _ordered(u, rank, percent)
                    row = (len(u), set_key(u), int(of[-1]), int((prefix[-1] ^ _TOP).astype(np.int64)))
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                names=["doc", "text_hash", "n", "key", "last_class", "last"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash")).mapInArrow(
        run, f"doc {kind}, text_hash long, n long, key long, last_class int, last long")


def _postings(docs: DataFrame, text: str, size: int, percent: int, order) -> DataFrame:
    """(s, key, n, pos) of the prefix incidences; a class is listed once per partition."""
    def run(batches):
        seen: set[int] = set()
        rank = order.value
        for b in batches:
            rows: list[tuple] = []
            for _, words in hashed_texts(as_bytes(b.column(0))):
                u = np.unique(shingle_hashes(words, size))
                if len(u) and (key := set_key(u)) not in seen:
                    seen.add(key)
                    rows.append((_ordered(u, rank, percent)[0].view(np.int64), key, len(u)))
                if len(rows) >= 256:
                    yield _posting_batch(rows)
                    rows = []
            if rows:
                yield _posting_batch(rows)

    return docs.select(F.col(text)).mapInArrow(run, "s long, key long, n int, pos int")


def _posting_batch(rows: list[tuple]) -> pa.RecordBatch:
    long = [len(r[0]) for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([r[0] for r in rows])), pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), long)),
         pa.array(np.repeat(np.array([r[2] for r in rows], np.int32), long)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in long]))],
        names=["s", "key", "n", "pos"])


_STAR = ("s", "a", "na", "pa", "b", "nb", "pb")


def _columns(postings: DataFrame) -> DataFrame:
    """Rows b that share prefix column s with its first row a, with sizes and places. Reads rows sorted by s, pos, key."""
    def run(batches):
        at = last = None  # the column, the row before
        first = (0, 0, 0)
        for batch in batches:
            s, key, n, pos = (c.to_numpy() for c in batch.columns)
            if not len(s):
                continue
            new = np.ones(len(s), dtype=bool)
            new[1:] = s[1:] != s[:-1]
            new[0] = at is None or s[0] != at
            same = np.zeros(len(s), dtype=bool)
            same[1:] = ~new[1:] & (key[1:] == key[:-1])
            same[0] = not new[0] and key[0] == last
            head = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            a, na, pos_a = (np.where(head >= 0, c[head], f) for c, f in zip((key, n, pos), first))
            at, last, first = s[-1], key[-1], (a[-1], na[-1], pos_a[-1])
            out = ~new & ~same & (key != a)
            if out.any():
                cols = (s, a, na.astype(np.int32), pos_a.astype(np.int32), key, n, pos)
                yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols], names=list(_STAR))

    return postings.mapInArrow(run, "s long, a long, na int, pa int, b long, nb int, pb int")


def _alpha(x: str, y: str, percent: int) -> str:
    """SQL: the overlap that sets of these sizes need."""
    return f"(({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent})"


def _first_places_allow(nx: str, px: str, ny: str, py: str, percent: int) -> str:
    """SQL: a pair's first shared column may stand at these places; all before it are missing in the other set."""
    alpha = _alpha(nx, ny, percent)
    return f"(100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny}) and {px} <= {nx} - {alpha} and {py} <= {ny} - {alpha})"


def _bounded(counts: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, c) that the sizes and c, their number of shared prefix columns, leave possible.

    The prefix that ends first in the order holds every column that it shares with the
    other set, so at most n - alpha of its columns may be missing there (alpha: the
    overlap that the threshold needs).
    """
    x, y = (info.select(*(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "last_class", "last"))) for side in "ab")
    j = counts.join(x, F.col("a") == F.col("key_a")).join(y, F.col("b") == F.col("key_b"))
    j = j.withColumn("alpha", F.expr(_alpha("n_a", "n_b", percent)))
    for side in "ab":
        p = f"(n_{side} - ({percent} * n_{side} + 99) div 100 + 1)"
        j = j.withColumn(f"need_{side}", F.expr(f"{p} - (n_{side} - alpha)"))
    a_first = "(last_class_a < last_class_b or (last_class_a = last_class_b and last_a <= last_b))"
    return j.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and c >= if({a_first}, need_a, need_b)").select("a", "b")


def _shared_columns(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b, c): in how many prefix columns both rows of each pair stand."""
    one = lists.select(F.col("key").alias("a"), F.col("columns").alias("columns_a"))
    two = lists.select(F.col("key").alias("b"), F.col("columns").alias("columns_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("columns_a", "columns_b")).cast("long").alias("c"))


def _row_sets(docs: DataFrame, text: str, size: int, pairs: DataFrame) -> DataFrame:
    """(key, grams) of the classes in the pairs; a filter of fixed size lets only few others into the shuffle."""
    def mark(batches):
        acc = np.zeros(1 << FILTER_BITS, dtype=np.int64)
        for b in batches:
            acc[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = 1
        return acc

    members = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    wanted = pairs.sparkSession.sparkContext.broadcast(summed_blocks(members, mark, 1 << FILTER_BITS) > 0)

    def run(batches):
        seen: set[int] = set()
        bits = wanted.value
        for b in batches:
            keys, grams = [], []
            for _, words in hashed_texts(as_bytes(b.column(0))):
                if not len(words):
                    continue
                u = np.unique(shingle_hashes(words, size))
                key = set_key(u)
                if bits[(key & (1 << 64) - 1) >> (64 - FILTER_BITS)] and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    grams.append(u.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], names=["key", "grams"])

    return docs.select(F.col(text)).mapInArrow(run, "key long, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs: overlap counts by block product, then the bound on the union."""
    parts = input_partitions(pairs.sparkSession)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    one = blocks.join(sets, blocks.a == sets.key).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.lit(0).alias("role"), F.col("a").alias("b"), "grams")
    many = pairs.join(blocks, "a").join(sets, F.col("b") == sets.key).select(
        "a", F.expr("cast(pmod(xxhash64(b), blocks) as int)").alias("blk"), F.lit(1).alias("role"), "b", "grams")

    def run(batches):
        at, row = None, None
        for b in batches:
            ka, kb, role, blk = (b.column(i).to_pylist() for i in (0, 3, 2, 1))
            a_out, b_out = [], []
            for i, data in enumerate(b.column(4)):
                u = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if role[i] == 0:
                    at, row = (ka[i], blk[i]), u.copy()
                    continue
                if at != (ka[i], blk[i]):
                    raise RuntimeError("a block's row is missing")
                where = np.searchsorted(row, u)
                where[where == len(row)] = 0
                overlap = int((row[where] == u).sum())
                if 100 * overlap >= percent * (len(row) + len(u) - overlap):
                    a_out.append(ka[i])
                    b_out.append(kb[i])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return one.unionByName(many).repartition(parts, "a", "blk").sortWithinPartitions("a", "blk", "role").mapInArrow(
        run, "a long, b long")


def link_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, class_key, component_id) of each document; component_id is the smallest id reachable."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_sketch(docs.select(F.col(text)), size))  # 2 MB, fixed
    sets = _sets(docs, id, text, size, percent, order).checkpoint()
    info = sets.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("last_class").alias("last_class"), F.first("last").alias("last"))
    postings = _postings(docs, text, size, percent, order)
    path = scratch_dir(spark, "columns")
    _columns(postings.repartition(input_partitions(spark), "s").sortWithinPartitions("s", "pos", "key")).write.parquet(path)
    stars = spark.read.parquet(path)

    # all prefix columns that a row shares with any other (at most its prefix): what two lists share is complete
    lists = stars.select("s", F.explode(F.array("a", "b")).alias("key")).distinct().groupBy("key").agg(F.collect_list("s").alias("columns"))
    first = stars.where(_first_places_allow("na", "pa", "nb", "pb", percent)).select("a", "b").distinct()
    pairs = _bounded(_shared_columns(first, lists), info, percent).checkpoint()
    links = _verify(pairs, _row_sets(docs, text, size, pairs), percent).checkpoint()
    near = components(links)
    # other rows of a column that can be the first that they share, where the links so far leave them apart
    label = near.select("node", F.col("component").alias("c")).checkpoint()

    def labelled(df, key, c):
        found = label.select(F.col("node").alias(key), F.col("c").alias(c))
        return df.join(found, key, "left").withColumn(c, F.coalesce(c, key))

    low = stars.groupBy("s").agg(F.min("nb").alias("lo"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s", "lo")
    # a row whose place is too deep for every size in its column leads nowhere
    reach = _alpha("nb", f"greatest(lo, ({percent} * nb + 99) div 100)", percent)
    shared = labelled(stars.join(low, "s").where(f"pb <= nb - {reach}").select("s", "b", "nb", "pb"), "b", "c")
    mixed = shared.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("s")
    rest = shared.join(mixed, "s").checkpoint()
    x, y = rest.alias("x"), rest.alias("y")
    among = x.join(y, F.expr(f"x.s = y.s and x.b < y.b and x.c != y.c and {_first_places_allow('x.nb', 'x.pb', 'y.nb', 'y.pb', percent)}"))
    among = among.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()
    decided = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = among.join(decided, ["a", "b"], "left_anti")
    more = _bounded(_shared_columns(more, lists), info, percent).checkpoint()
    if not more.isEmpty():
        late = _verify(more, _row_sets(docs, text, size, more), percent)
        near = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))

    classes = sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("low"))
    classes = classes.join(near, classes.key == near.node, "left").select("key", "low", F.coalesce("component", "key").alias("c"))
    smallest = classes.groupBy("c").agg(F.min("low").alias("component_id"))
    by_class = classes.join(smallest, "c").select("key", "component_id")
    return sets.select("doc", "text_hash", "n", "key").join(by_class, "key", "left").select(
        F.col("doc").alias(id), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), "text_hash",
        F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest id; all columns as they are.

    Documents without words stay. Repeated rows (equal id and text) count as copies; rows
    that share the smallest id and differ in text all stay.
    """
    links = link_documents(docs, text, id, size, percent)
    keep = links.where(F.col(id).eqNullSafe(F.col("component_id"))).select(
        F.col(id).alias("keep_id"), F.col("text_hash").alias("keep_hash"), F.col("class_key").isNull().alias("wordless")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col(id).alias("row_id"), F.xxhash64(F.col(text)).alias("row_hash"), row.alias("row"))
    found = rows.join(keep, rows.row_id.eqNullSafe(keep.keep_id) & (rows.row_hash == keep.keep_hash))
    # repeated rows meet here, in the partitions of the join; those without words are told apart
    found = found.withColumn("own", F.when(F.col("wordless"), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return found.dropDuplicates(["row_id", "row_hash", "own"]).select("row.*")
