"""Centroid clustering over subvector dictionaries.

Vectors become integers, floor(scale * x), and are stored in chunks of ``CHUNK`` rows.
In a chunk every block of dimensions has a dictionary of its distinct subvectors, and each
vector is a code per block, without loss. Blocks start one dimension wide and neighbours
join as long as the distinct subvectors of both together are at most ``SHARE`` of the
rows, so copies and coarse values give wide blocks and few codes.

A round computes the exact distance of every dictionary entry to the centroids' part of
its block once, sums these partial distances by code, and takes the nearest centroid.
Sums of the vectors by cluster come from the dictionaries too: entries times how often a
cluster has their code. The chunk table is written once and dealt as Spark reads it; a
round moves one row of sums per task and cluster, the driver holds the centroids alone.

Centroids are exact integers: floor(sum / count) per component, empty clusters stay. The
first ones are the vectors with the smallest sha256 of ``<seed>:<id>``.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components are left out; products beyond 2^27 count as 2^27, so that a distance is a long;
fewer vectors than centroids: as many centroids as vectors; rows with equal ids are
vectors each (ties of their hash go by components); a null id is hashed as ``null``;
repeated rows share a cluster; equal distances: the smaller number; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.session import scratch_dir

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: rows of a chunk, at most
CHUNK = 16_384
#: distinct subvectors a joined block may have, as a share of the rows
SHARE = 0.5
#: largest absolute component
TOP = 1 << 27


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept row numbers, their vectors as integers) of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool) & (lengths == dim)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return rows, np.zeros((0, dim), dtype=np.int64)
    values = column.values.cast(pa.float64())
    flat = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)  # null becomes nan
    x = flat[column.offsets.to_numpy()[:-1][rows][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(scale * x[good]), -TOP, TOP)
    return rows[good], scaled.astype(np.int64)


def dictionaries(x: np.ndarray, share: float = SHARE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(first dimension, entries, codes)]: blocks with their distinct subvectors, and each row's entry."""
    n = len(x)
    blocks = []
    for d in range(x.shape[1]):
        entries, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((d, entries[:, None], codes.astype(np.int64)))
    joined = True
    while joined and len(blocks) > 1:
        joined, out, i = False, [], 0
        while i < len(blocks):
            if i + 1 < len(blocks):
                (d, a, ca), (_, b, cb) = blocks[i], blocks[i + 1]
                pairs, codes = np.unique(ca * len(b) + cb, return_inverse=True)
                if len(pairs) <= share * n:
                    out.append((d, np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes.astype(np.int64)))
                    joined, i = True, i + 2
                    continue
            out.append(blocks[i])
            i += 1
        blocks = out
    return blocks


def assign(blocks: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance) of each row, exactly."""
    total = 0
    for d, entries, codes in blocks:
        own = centroids[:, d:d + entries.shape[1]]
        part = ((entries[:, None, :] - own[None]) ** 2).sum(axis=2)
        total = total + part[codes]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(total)), nearest]


def sums_by_cluster(blocks, nearest: np.ndarray, k: int, dim: int) -> np.ndarray:
    """Sum of the vectors of each cluster (k by dim), from entries and how often each cluster has them."""
    out = np.zeros((k, dim), dtype=np.int64)
    for d, entries, codes in blocks:
        often = np.bincount(codes * k + nearest, minlength=len(entries) * k).reshape(len(entries), k)
        out[:, d:d + entries.shape[1]] = often.T @ entries
    return out


# ------------------------------------------------------------------ Spark
_BLOCKS = "n int, first array<int>, width array<int>, sizes array<int>, entries binary, codes binary"


def _stored(ids: list[pa.Array], x: np.ndarray) -> pa.RecordBatch:
    blocks = dictionaries(x)
    kind = pa.list_(pa.int32())
    listed = ids[0] if len(ids) == 1 else pa.concat_arrays(ids)
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), pa.array([len(x)], pa.int32()),
         pa.array([[b[0] for b in blocks]], kind), pa.array([[b[1].shape[1] for b in blocks]], kind), pa.array([[len(b[1]) for b in blocks]], kind),
         pa.array([b"".join(b[1].astype("<i4").tobytes() for b in blocks)], pa.binary()),
         pa.array([b"".join(b[2].astype("<u2").tobytes() for b in blocks)], pa.binary())],
        names=["ids", "n", "first", "width", "sizes", "entries", "codes"])


def _loaded(n: int, first, width, sizes, entries: bytes, codes: bytes):
    out, at = [], 0
    for i, (d, w, m) in enumerate(zip(first, width, sizes)):
        e = np.frombuffer(entries, dtype="<i4", count=m * w, offset=4 * at).reshape(m, w).astype(np.int64)
        out.append((d, e, np.frombuffer(codes, dtype="<u2", count=n, offset=2 * n * i).astype(np.int64)))
        at += m * w
    return out


def _blocks_of(batch: pa.RecordBatch):
    """(row number, blocks) of each chunk of a batch whose last columns are those of _BLOCKS."""
    cols = batch.columns[-6:]
    for r in range(batch.num_rows):
        yield r, _loaded(*(c[r].as_py() for c in cols))


def encode_chunks(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """The written table of chunks: ids, and per block its dictionary and codes."""
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches):
        ids, xs, n = [], [], 0
        for b in batches:
            rows, x = whole_numbers(b.column(1), dim, scale)
            own = b.column(0).take(pa.array(rows))
            while len(x):
                some = min(CHUNK - n, len(x))
                ids.append(own[:some])
                xs.append(x[:some])
                own, x, n = own[some:], x[some:], n + some
                if n == CHUNK:
                    yield _stored(ids, np.concatenate(xs))
                    ids, xs, n = [], [], 0
        if n:
            yield _stored(ids, np.concatenate(xs))

    path = scratch_dir(vectors.sparkSession, "chunks")
    vectors.select(F.col(f"`{id}`"), F.col(f"`{embedding}`")).mapInArrow(run, f"ids array<{kind}>, {_BLOCKS}").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def first_centroids(chunks: DataFrame, k: int = K, seed: int = SEED, dim: int = DIM) -> np.ndarray:
    """The vectors with the k smallest sha256 of ``seed:id``; each task sends its k smallest."""
    def run(batches):
        best: list = []
        for b in batches:
            for r, blocks in _blocks_of(b):
                ids = b.column(0)[r].as_py()
                keys = [hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest() for i in ids]
                cut = heapq.nsmallest(k, keys)[-1]  # ties of the k-th go on, to be settled by components
                some = [i for i, key in enumerate(keys) if key <= cut]
                x = np.concatenate([entries[codes[some]] for _, entries, codes in blocks], axis=1)
                best = heapq.nsmallest(k, [*best, *zip([keys[i] for i in some], x.tolist())])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([x for _, x in best], pa.list_(pa.int64()))], names=["h", "x"])

    rows = chunks.mapInArrow(run, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64).reshape(len(rows), dim)


def next_centroids(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: exact floors of the clusters' means; empty clusters keep theirs."""
    k, dim = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            for _, blocks in _blocks_of(b):
                nearest, _ = assign(blocks, centroids)
                sums += sums_by_cluster(blocks, nearest, k, dim)
                counts += np.bincount(nearest, minlength=k)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.column_stack([counts, sums])[some].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "v"])

    parts = chunks.mapInArrow(run, "cluster int, v array<long>").select("cluster", F.posexplode("v").alias("i", "v"))
    out = [[int(v) for v in c] for c in centroids]
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():  # k * (dim + 1) rows
        found.setdefault(r.cluster, {})[r.i] = int(r.v)
    for c, v in found.items():
        out[c] = [v[d + 1] // v[0] for d in range(dim)]
    return np.array(out, dtype=np.int64).reshape(k, dim)


def cluster(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each kept vector as a written table, the final centroids)."""
    spark, kind = vectors.sparkSession, vectors.schema[id].dataType.simpleString()
    chunks = encode_chunks(vectors, id, embedding, dim, scale)
    centroids = first_centroids(chunks, k, seed, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(chunks, centroids)

    def run(batches):
        for b in batches:
            for r, blocks in _blocks_of(b):
                nearest, distance = assign(blocks, centroids)
                yield pa.RecordBatch.from_arrays([b.column(0)[r].values, pa.array(nearest.astype(np.int32)), pa.array(distance)],
                                                 names=[id, "cluster", "distance"])

    path = scratch_dir(spark, "clusters")
    chunks.mapInArrow(run, f"`{id}` {kind}, cluster int, distance long").write.parquet(path)
    return spark.read.parquet(path), centroids


def cluster_report(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS,
                   scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    rows, centroids = cluster(vectors, id, embedding, dim, k, rounds, scale, seed)
    spread = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # k rows
    n = max(len(centroids), 1)
    own = F.array(*(F.lit(spread.get(c, 0)).cast("long") for c in range(n)))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for x in (centroids.tolist() or [[]])))
    return rows.select(F.col(f"`{id}`"), "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"),
                       F.lit(sum(spread.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))


def cluster_sql(rounds: int = ROUNDS, k: int = K, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for cluster_report() over ``embeddings``: distances component by component."""
    distance = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def near(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT place, vec_id, x, min(s) AS distance, arg_min(number, s * {k} + number) AS number
  FROM (SELECT v.place, vec_id, x, number, CAST({distance} AS BIGINT) AS s FROM v CROSS JOIN c{n}) GROUP BY ALL)"""

    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS number, x AS y FROM v
  QUALIFY number < {k})"""]
    for n in range(rounds):
        parts += [near(n), f"""c{n + 1} AS MATERIALIZED (
  SELECT number, coalesce(m, y) AS y FROM c{n} LEFT JOIN (
    SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
    FROM (SELECT number, i, sum(x[i]) AS s, count(*) AS n FROM a{n} CROSS JOIN range(1, {dim + 1}) AS r(i) GROUP BY ALL) GROUP BY number) USING (number))"""]
    parts.append(near(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (number)"""
