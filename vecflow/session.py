"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (the
folder the cluster names for checkpoints). Only when the session has none
(local tests, bench) do we set one, under a fresh ``mkdtemp`` folder.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "vecflow",
              extra: dict | None = None) -> SparkSession:
    """Session tuned for local runs. The UI stays off (no server)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VECFLOW_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a local one only if unset and the
    whole session runs in one process. A cluster must name a folder that it shares."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {sc.master} share no local folder")
        conf_dir = tempfile.mkdtemp(prefix="vecflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def kept_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder that is not removed with the scratch folders."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vecflow-{name}-{uuid.uuid4().hex[:12]}"


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A new, unique folder under the shared checkpoint folder.

    Used for tables written to cut lineage or for round-trip checks; never a
    machine-local temp folder on a cluster. The folder goes when the Python
    process ends; ``clean_scratch`` removes what was made so far.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/vecflow-{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_clean_at_exit, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def _clean_at_exit(spark: SparkSession) -> None:
    # a context that was stopped before has no JVM left to ask
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):
            clean_scratch(spark)


def clean_scratch(spark: SparkSession) -> None:
    """Delete this process's scratch folders; results that still read them must be done."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder that is no longer read."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vecflow`` importable on executors (Python workers), once per context.

    The package is zipped on the driver and handed to ``addPyFile``, the same
    mechanism as ``--py-files``; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="vecflow-pyfiles-")
    zip_path = os.path.join(out_dir, "vecflow.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)


LISTING_PARALLELISM = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class bounded_listing:
    """Scope in which Spark lists many paths with at most one task per core.

    Past 32 paths Spark lists files with a Spark job of up to 10,000 tasks --
    one per path for thousands of small report folders. File listing happens
    when the DataFrame is created, so the setting only needs to hold around
    ``load()``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.previous = None

    def __enter__(self):
        self.previous = self.spark.conf.get(LISTING_PARALLELISM, None)
        cores = self.spark.sparkContext.defaultParallelism
        current = int(self.previous) if self.previous else 10000
        self.spark.conf.set(LISTING_PARALLELISM, str(max(1, min(current, cores))))
        return self

    def __exit__(self, *exc):
        if self.previous is None:
            self.spark.conf.unset(LISTING_PARALLELISM)
        else:
            self.spark.conf.set(LISTING_PARALLELISM, self.previous)
        return False
