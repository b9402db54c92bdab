"""Embedding near-duplicates by iterative quantisation.

A rotation is learned on a bounded sample so that the signs of the rotated vectors are
balanced codes that lose little (iterative quantisation: alternate between the signs and
the orthogonal Procrustes solution). A few rotations from different starts give
``TABLES`` substrings of 16 bits; each is a table of a multi-index, and two vectors are
candidates when they agree in one whole substring of any table. Candidates are compared
by their original vectors, cosine in double precision, in blocks of a bounded number of
rows: a bucket larger than that is cut into blocks and every pair of blocks is a task of
its own, so a hot bucket is never in one place and no pair of vectors is ever a row.

A pair met in several tables is counted in the first one only (the codes tell which).
Each block returns link counts per vector and a forest of its links; the forests'
components are the result's components. Equal vectors with equal labels are one row in
all of this, with a multiplicity.

Two vectors at the threshold (11.5 degrees apart) differ in about 6 % of the bits, so a
substring agrees with probability 0.35 and one of twelve with 0.99; the measured recall
against brute force is in the tests and in README.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing, as do rows with a null id; vectors of different
lengths are never compared; rows that share an id are one node; repeated rows are links
of each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import input_partitions
from vecflow.llm.components import components

THRESHOLD = 0.98
TABLES = 12
BITS = 16
#: vectors that the rotations are learned on, at most
SAMPLE = 20_000
ROUNDS = 25
#: rows per block of a bucket, about
BLOCK = 1024


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotation for balanced codes of unit vectors ``x`` (rows), uncentred: the angle is about the origin."""
    dim = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    r = random_rotation(dim, seed)
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def layout(dim: int, tables: int = TABLES, bits: int = BITS) -> tuple[int, int, int]:
    """(bits of a substring, substrings per rotation, rotations) for vectors of ``dim`` components."""
    bits = min(bits, dim)
    per = dim // bits
    return bits, per, -(-tables // per)


def substrings(x: np.ndarray, rotations: list[np.ndarray], tables: int = TABLES) -> np.ndarray:
    """One substring value per row and table."""
    bits, per, _ = layout(x.shape[1], tables)
    weights = (1 << np.arange(bits)).astype(np.int64)
    out = []
    for r in rotations:
        signs = (x @ r >= 0)[:, :bits * per].reshape(len(x), per, bits)
        out.append(signs @ weights)
    return np.concatenate(out, axis=1)[:, :tables].astype(np.int32)


def unit(values) -> np.ndarray | None:
    """The vector at length one in double precision, or None if it has no direction."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64) if isinstance(values, list) else values.astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or not top > 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _rows(vectors: DataFrame, id: str, embedding: str, label: str) -> DataFrame:
    """(vec, label, key, data): key tells label and vector apart, null where the row links with nothing."""
    def run(batches):
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, data = [], []
            for v, lab, e in zip(ids, labels, b.column(2)):
                x = None
                if v is not None and lab is not None and e.is_valid:
                    x = unit(e.values.to_numpy(zero_copy_only=False)) if not e.values.null_count else None
                data.append(None if x is None else x.tobytes())
                keys.append(None if x is None else xxhash.xxh3_128_digest(str(lab).encode() + b"\0" + e.values.to_numpy().tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                                             names=["vec", "label", "key", "data"])

    kind = vectors.schema[id].dataType.simpleString()
    return vectors.select(F.col(id), F.col(label), F.col(embedding)).mapInArrow(run, f"vec {kind}, label string, key binary, data binary")


def learned(classes: DataFrame, tables: int = TABLES, sample: int = SAMPLE) -> dict[int, list[np.ndarray]]:
    """Rotations by vector length, from the sample whose keys are smallest (a fixed, evenly spread choice)."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in classes.select("key", "data").orderBy("key").limit(sample).toLocalIterator():
        x = np.frombuffer(r.data)
        by_dim.setdefault(len(x), []).append(x)
    return {d: [learn_rotation(np.stack(xs), seed) for seed in range(layout(d, tables)[2])] for d, xs in by_dim.items()}


def _entries(classes: DataFrame, rotations, tables: int, kind: str) -> DataFrame:
    """One row per vector and table: (table, label, dim, sub, node, copies, data, codes)."""
    def run(batches):
        for b in batches:
            nodes, labels, copies, data = (b.column(i) for i in range(4))
            raw = data.to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, d in enumerate(raw):
                by_dim.setdefault(len(d) // 8, []).append(i)
            for dim, rows in by_dim.items():
                x = np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), dim)
                known = rotations.value.get(dim) or [random_rotation(dim, s) for s in range(layout(dim, tables)[2])]
                codes = substrings(x, known, tables)
                take = pa.array(rows, pa.int64())
                listed = pa.array([c.tobytes() for c in codes], pa.binary())
                for t in range(codes.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), labels.take(take), pa.array(np.full(len(rows), dim, np.int32)),
                         pa.array(codes[:, t]), nodes.take(take), copies.take(take), data.take(take), listed],
                        names=["t", "label", "dim", "sub", "node", "copies", "data", "codes"])

    return classes.select("node", "label", "copies", "data").mapInArrow(
        run, f"t int, label string, dim int, sub int, node {kind}, copies long, data binary, codes binary")


def compare(x: np.ndarray, codes: np.ndarray, t: int, copies: np.ndarray, side: np.ndarray | None,
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted in table ``t`` per row, root row of each row) for rows of one block pair.

    ``side``: 0 or 1, the block of each row; only pairs across blocks are compared. None: all pairs.
    """
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    counted = np.ones(len(i), dtype=bool)
    if t:
        counted = ~(codes[i, :t] == codes[j, :t]).any(axis=1)
    links = np.bincount(i[counted], weights=copies[j[counted]], minlength=len(x)).astype(np.int64)
    root = np.arange(len(x))
    if len(i):
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            low = low[low]
            if (low == root).all():
                break
            root = low
    return links, root


def _compared(entries: DataFrame, threshold: float, kind: str, tables: int) -> DataFrame:
    """(node, links, other): per block pair, link counts and forest links (other is null for counts alone)."""
    bucket = ["t", "label", "dim", "sub"]
    hot = entries.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = F.expr("cast(pmod(xxhash64(node), blocks) as int)")
    dealt = entries.join(hot, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "copies", "data", "codes")
    keys = [*bucket, "i", "j"]

    def work(group, rows):
        if len(rows) < 2:
            return None
        nodes = np.array([r[0] for r in rows])
        x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), group[2])
        codes = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.int32).reshape(len(rows), -1)
        copies = np.array([r[1] for r in rows], dtype=np.float64)
        side = np.array([int(r[4] == group[5]) for r in rows]) if group[4] != group[5] else None
        links, root = compare(x, codes, group[0], copies, side, threshold)
        keep = (links > 0) | (root != np.arange(len(rows)))
        if not keep.any():
            return None
        other = nodes[root]
        return nodes[keep], links[keep], other[keep]

    def run(batches):
        at, rows = None, []
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for t, label, dim, sub, i, j, mine, node, copies, data, codes in zip(*cols):
                if (t, label, dim, sub, i, j) != at:
                    if rows:
                        out.append(work(at, rows))
                    at, rows = (t, label, dim, sub, i, j), []
                rows.append((node, copies, data, codes, mine))
            yield from _links(out)
        if rows:
            yield from _links([work(at, rows)])

    parts = input_partitions(entries.sparkSession)
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"node {kind}, links long, other {kind}")


def _links(found: list):
    found = [f for f in found if f]
    if found:
        n, k, o = (np.concatenate(c) for c in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k), pa.array(o)], names=["node", "links", "other"])


def link_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """(id, n_links, component_id, kept) of each vector; component_id is the smallest id reachable by links."""
    kind = vectors.schema[id].dataType.simpleString()
    rows = _rows(vectors, id, embedding, label)
    classes = rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("data").alias("data"), F.min("vec").alias("node"), F.count(F.lit(1)).alias("copies")).checkpoint()
    rotations = vectors.sparkSession.sparkContext.broadcast(learned(classes, tables))  # a few square matrices
    found = _compared(_entries(classes, rotations, tables, kind), threshold, kind, tables).checkpoint()
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    near = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    result = classes.select("key", "node", "copies").join(counts, "node", "left").join(near, "node", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    return rows.select("vec", "key").join(result, "key", "left").select(
        F.col("vec").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        F.coalesce(F.col("vec") == F.coalesce("component_id", "vec"), F.lit(True)).alias("kept"))
