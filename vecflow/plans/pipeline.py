"""The timed pipeline -- source -> shift -> block means -> reduce -> report.

Eager mode (the reference default) materialises every phase and counts it,
releasing the previous phase once the next is stored; each phase's time then
is the time of its own job. Lazy mode builds the whole plan and runs it once
at the reduce; source rows are counted where they pass (an observed metric),
shifted rows by the matrix aggregate that reads them, so the counts cost no
extra pass and none is inferred from another.

``store`` says where eager phases go. ``"files"`` (the default): columnar files
in the session's shared checkpoint folder, rows counted by a metric observed on
the write -- one pass a phase, nothing held on executors, and a lost executor
loses nothing. ``"memory"``: ``persist(storage_level)`` and a count (recomputable
after executor loss, as the generator is deterministic). ``"checkpoint"`` (or
``checkpoint=True``): a reliable checkpoint. Only the columns the phases read
are kept.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vecflow.functions.report_columns import NS_PER_S
from vecflow.operators.means import block_means, choose_method
from vecflow.operators.reduce import reduce_block_means
from vecflow.operators.shift import SHIFT, shift
from vecflow.session import ensure_checkpoint_dir, remove_scratch, scratch_dir
from vecflow.sinks.report_files import DEFAULT_EXPERIMENT, write_report_files
from vecflow.sinks.vectors import write_vectors
from vecflow.sources.generate import DEFAULT_CORES, MEGA_MULTIPLIER
from vecflow.sources.load import VECTOR_COLUMNS, load_vectors

PHASES = ("map", "shift", "average", "reduce")


@dataclass
class PipelineRun:
    result: dict                      # sum_of_block_means_{x,y,z}
    timings: dict                     # seconds per phase + overall (sum of phases)
    counts: dict = field(default_factory=dict)
    report: DataFrame | None = None   # one results-shaped row (times in ns) + run extras
    block_means: DataFrame | None = None


# Cache settings for vector phases: random doubles do not compress, so the
# columnar cache skips compression, and larger batches amortise per-batch cost
# (measured ~25% less time per eager phase).
CACHE_CONF = {
    "spark.sql.inMemoryColumnarStorage.compressed": "false",
    "spark.sql.inMemoryColumnarStorage.batchSize": "100000",
}


class _cache_settings:
    """Scope for building a phase's cache (the settings are read while it is built)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.saved = spark, {}

    def __enter__(self):
        for k, v in CACHE_CONF.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


STORES = ("files", "memory", "checkpoint")
# Phase files are read once, by the next phase: no compression or dictionaries for random doubles.
FILE_OPTIONS = {"compression": "none", "parquet.writer.version": "PARQUET_2_0", "parquet.page.write-checksum.enabled": "false",
                **{f"parquet.enable.dictionary#{c}": "false" for c in "xyz"}}


class PhaseStore:
    """Stores one phase after the other; each is released on request, once the next is stored."""

    def __init__(self, spark: SparkSession, kind: str, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        if kind not in STORES:
            raise ValueError(f"store must be one of {STORES}, got {kind!r}")
        self.spark, self.kind, self.level = spark, kind, level
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The stored phase and its number of rows (the reference's persist + count)."""
        if self.kind == "files":
            path, seen = scratch_dir(self.spark, "phase"), Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**FILE_OPTIONS).parquet(path)
            stored = self.spark.read.schema(df.schema).parquet(path)
            self.paths[id(stored)] = path
            return stored, seen.get["rows"]
        if self.kind == "checkpoint":
            ensure_checkpoint_dir(self.spark)
            stored = df.checkpoint(eager=True)  # computed once; the count reads what is stored
            return stored, stored.count()
        with _cache_settings(self.spark):
            stored = df.persist(self.level)
            return stored, stored.count()

    def release(self, stored: DataFrame) -> None:
        if self.kind == "files":
            remove_scratch(self.spark, self.paths.pop(id(stored)))
        elif self.kind == "memory":
            stored.unpersist()


# The phases read only these columns; without ``dst`` anything else is dropped before caching.
PHASE_COLUMNS = ("block_id", "matrix_id", "x", "y", "z")
UNKNOWN = None  # run settings that a given DataFrame does not tell


def run_pipeline(
    spark: SparkSession,
    vectors: DataFrame | None = None,
    *,
    generate: bool = False,
    src: str | None = None,
    dst: str | None = None,
    lazy: bool = False,
    functional: bool = False,
    hybrid: bool = False,
    imperative: bool = False,
    blocks: int = 1,
    block_size: int = 1,
    multiplier: int = MEGA_MULTIPLIER,
    nodes: int = 1,
    cores: int = DEFAULT_CORES,
    nparts: int = 1,
    size: int = 1,
    seed: int = 0,
    displacement=SHIFT,
    store: str | None = None,
    checkpoint: bool = False,
    storage_level: StorageLevel | None = None,
    experiment_id: str = DEFAULT_EXPERIMENT,
    job_id: str | None = None,
    json_dir: str | None = None,
    xml_dir: str | None = None,
) -> PipelineRun:
    method = choose_method(functional, hybrid, imperative)
    # a storage level asks for caches
    kind = store or ("checkpoint" if checkpoint else "memory" if storage_level else "files")
    phases = PhaseStore(spark, kind, storage_level or StorageLevel.MEMORY_AND_DISK)
    counts: dict = {}
    timings: dict = {}

    # --- map (source) ---
    t0 = time.perf_counter()
    if vectors is not None:
        a = vectors
    else:  # S4: generate wins over src; neither raises
        a = load_vectors(spark, generate=generate, src=src, columns=VECTOR_COLUMNS if dst else PHASE_COLUMNS, blocks=blocks, block_size=block_size,
                         multiplier=multiplier, nodes=nodes, cores=cores, nparts=nparts, seed=seed)
    if not dst:
        a = a.select(*PHASE_COLUMNS)
    seen = Observation()
    if lazy:
        a = a.observe(seen, F.count(F.lit(1)).alias("rows"))
    else:
        a, counts["generate"] = phases.keep(a)
    timings["map"] = time.perf_counter() - t0

    # --- shift ---
    t0 = time.perf_counter()
    b = shift(a, displacement)
    if not lazy:
        b, counts["shift"] = phases.keep(b)
        phases.release(a)
    timings["shift"] = time.perf_counter() - t0

    # --- average ---
    t0 = time.perf_counter()
    c = block_means(b, method, with_rows=lazy)
    if not lazy:
        c, counts["average"] = phases.keep(c)
        if not dst:
            phases.release(b)
    timings["average"] = time.perf_counter() - t0

    # --- reduce ---
    t0 = time.perf_counter()
    reduced = reduce_block_means(c)
    if lazy:
        reduced = c.agg(*[F.sum(x).alias(f"sum_of_block_means_{x}") for x in ("x", "y", "z")],
                        F.count(F.lit(1)).alias("__blocks"), F.sum("n_rows").alias("__rows"))
    result = reduced.first().asDict()
    timings["reduce"] = time.perf_counter() - t0
    if lazy:
        counts.update(generate=seen.get["rows"], shift=int(result.pop("__rows") or 0), average=int(result.pop("__blocks")))
        c = c.drop("n_rows")
    timings["overall"] = sum(timings[p] for p in PHASES)

    if dst:  # the stored shift phase in eager mode
        write_vectors(b, dst)
        if not lazy:
            phases.release(b)

    job_id = job_id or uuid.uuid4().hex[:12]
    ns = {p: float(round(timings[p] * NS_PER_S)) for p in PHASES}
    if vectors is not None:
        nodes = cores = nparts = blocks = block_size = multiplier = UNKNOWN
    report = spark.createDataFrame(
        [(
            experiment_id, UNKNOWN if vectors is not None else int(bool(generate)), nodes, cores, nparts, blocks, block_size,
            ns["map"], ns["shift"], ns["average"], job_id, src or "", dst or "",
            1 if lazy else 0, multiplier, size, 1 if functional else 0,
            1 if hybrid else 0, 1 if imperative else 0, ns["reduce"],
        )],
        "experiment_id string, generate int, nodes int, cores int, nparts int, blocks int, block_size int, "
        "map_time double, shift_time double, avg_time double, job_id string, src string, dst string, "
        "lazy int, multiplier int, size int, functional int, hybrid int, imperative int, reduce_time double",
    )
    formats = [f for f, d in (("json", json_dir), ("xml", xml_dir)) if d]
    for f, d in (("json", json_dir), ("xml", xml_dir)):
        if d:
            write_report_files(report, d, f, 2, formats)
    if not lazy and phases.kind == "memory":
        phases.release(c)  # recomputed on use; stored block means (one row a block) stay readable
    return PipelineRun(result=result, timings=timings, counts=counts, report=report, block_means=c)
