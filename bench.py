"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is run to completion with the no-op sink (full computation, nothing
collected to the driver); the best of $BENCH_REPEAT (default 2) runs is kept,
after a warm-up that starts the JVM's code paths and the Python workers. The generated pipeline reproduces the reference
benchmark's phases (map = generate, shift, average, reduce) in eager mode and
in lazy mode; vectors/s per core is reported next to it for comparison with
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from vecflow.plans import catalog  # noqa: E402
from vecflow.plans.pipeline import run_pipeline  # noqa: E402
from vecflow.session import get_spark, scratch_dir  # noqa: E402
from vecflow.sinks.vectors import write_vec3  # noqa: E402
from vecflow.sources.generate import generate_vectors  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
# Generated pipeline size: (blocks + 1) * block_size * multiplier vectors.
GEN = dict(blocks=int(os.environ.get("BENCH_GEN_BLOCKS", "1")),
           block_size=int(os.environ.get("BENCH_GEN_BLOCK_SIZE", "8")),
           multiplier=int(os.environ.get("BENCH_GEN_MULTIPLIER", str(1024 * 1024))),
           nodes=1, cores=CPUS, nparts=int(os.environ.get("BENCH_GEN_NPARTS", "2")))
# File-source run (the reference's --src mode): vectors written once as vec3 files.
SRC_BLOCK_SIZE = int(os.environ.get("BENCH_SRC_BLOCK_SIZE", "2"))

HEADLINE = [
    "shift_vectors", "matrix_sums", "matrix_means", "block_means", "block_means_hybrid",
    "reduce_block_means", "global_mean", "mean_of_block_means", "phase_counts", "scale_vectors",
    "vector_shift_nd", "vector_sum_nd", "generate_structure", "uniform_buckets",
    "overall_sorted", "overall_sorted_gb", "overall_sum_gb", "runs_by_nodes", "distinct_blocks",
    "distinct_gb", "weak_series", "strong_series", "scaling_points", "scale_vectors_nd", "weak_series_for_blocks",
    "strong_series_for_gb", "runs_by_blocks_and_size", "vec3_roundtrip", "vectors_sink_roundtrip", "pipeline_dst",
    "timed_run_report", "timed_run_result", "timed_run_src", "report_json_native", "report_xml_native", "results_table",
    "export_tsv", "export_file", "vec3_block", "results_catalog", "results_sql_sorted", "results_sql_gb", "overall_sorted_order",
    # one small file per run, as the format asks: measured once
    "reports_flatten", "report_xml", "report_stream",
]
ONCE = {"reports_flatten", "report_xml", "report_stream"}


def _sf(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))


def io_by_job_group(event_dir: str) -> dict[str, dict[str, int]]:
    """Shuffle bytes written and input records read per job group, from the event log."""
    stage_group: dict[int, str] = {}
    totals: dict[str, dict[str, int]] = {}
    # Spark 4 writes rolling logs: <event_dir>/eventlog_v2_<app>/events_<n>_<app>
    paths = sorted(glob.glob(os.path.join(event_dir, "**", "events_*"), recursive=True),
                   key=lambda p: int(re.search(r"events_(\d+)_", os.path.basename(p)).group(1)))
    paths = paths or [p for p in glob.glob(os.path.join(event_dir, "*")) if os.path.isfile(p)]
    for path in paths:
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if group:
                        t = totals.setdefault(group, {"shuffle_bytes_written": 0, "input_records": 0})
                        shuffle = m.get("Shuffle Write Metrics") or {}
                        t["shuffle_bytes_written"] += shuffle.get("Shuffle Bytes Written", 0)
                        t["input_records"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
    return totals


def run_query(spark, name: str, repeat: int = 1) -> float:
    """Best of ``repeat`` runs (plan + full execution) of one catalogue query."""
    best = float("inf")
    for _ in range(repeat):
        t0 = time.perf_counter()
        df = catalog.QUERIES[name](spark, SF_DIR)
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t0)
    return best


def main() -> None:
    # event log in a scratch folder of this run: per-query shuffle and input bytes
    event_dir = tempfile.mkdtemp(prefix="vecflow-bench-events-")
    spark = get_spark(f"local[{CPUS}]", shuffle_partitions=CPUS * 2, app="vecflow-bench",
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir,
                             "spark.eventLog.compress": "false"})
    catalog._prepare(spark)
    t0 = time.perf_counter()
    run_query(spark, "uniform_buckets")  # warm-up: JVM, codegen, Python workers
    run_query(spark, "block_means_hybrid")
    warmup = time.perf_counter() - t0

    times: dict[str, float] = {}
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        times[name] = round(run_query(spark, name, 1 if name in ONCE else REPEAT), 4)
    spark.sparkContext.setJobGroup("other", "timed runs")

    n_vec = (GEN["blocks"] + 1) * GEN["block_size"] * GEN["multiplier"]
    extra = {}
    for mode, lazy, store in (("eager", False, "files"), ("eager_memory", False, "memory"), ("lazy", True, None)):
        runs = [run_pipeline(spark, generate=True, lazy=lazy, store=store, **GEN) for _ in range(REPEAT)]
        run = min(runs, key=lambda r: r.timings["overall"])
        for phase in ("map", "shift", "average", "reduce", "overall"):
            times[f"timed_run_{mode}_{phase}"] = round(run.timings[phase], 4)
        extra[f"timed_run_{mode}_vectors_per_sec_per_core"] = round(n_vec / run.timings["overall"] / CPUS)
        if not lazy:
            extra[f"timed_run_{mode}_map_vectors_per_sec_per_core"] = round(n_vec / run.timings["map"] / CPUS)
            extra[f"timed_run_{mode}_shift_vectors_per_sec_per_core"] = round(n_vec / run.timings["shift"] / CPUS)

    # file source: one planar file per task, written untimed, then timed runs reading them
    src = scratch_dir(spark, "bench-vec3")
    gen_src = generate_vectors(spark, blocks=1, block_size=SRC_BLOCK_SIZE, multiplier=GEN["multiplier"],
                               num_partitions=CPUS)
    write_vec3(gen_src, src)
    n_src = 2 * SRC_BLOCK_SIZE * GEN["multiplier"]
    for mode, lazy in (("eager", False), ("lazy", True)):
        runs = [run_pipeline(spark, src=src, lazy=lazy) for _ in range(REPEAT)]
        run = min(runs, key=lambda r: r.timings["overall"])
        for phase in ("map", "shift", "average", "reduce", "overall"):
            times[f"timed_run_src_{mode}_{phase}"] = round(run.timings[phase], 4)
        extra[f"timed_run_src_{mode}_vectors_per_sec_per_core"] = round(n_src / run.timings["overall"] / CPUS)
    extra["src_vectors"] = n_src

    total = sum(v for k, v in times.items() if k in HEADLINE or k.endswith("_overall"))
    out = {
        "metric": "total_query_time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": times,
        "sf": _sf(SF_DIR),
        "cpus": CPUS,
        "warmup_sec": round(warmup, 3),
        "generated_vectors": n_vec,
        "generated_config": GEN,
        "repeat": REPEAT,
        **extra,
    }
    spark.stop()
    io = io_by_job_group(event_dir)
    runs = {k: 1 if k in ONCE else REPEAT for k in times}
    out["shuffle_bytes_written"] = {k: v["shuffle_bytes_written"] // runs[k] for k, v in io.items() if k in times}
    out["input_records"] = {k: v["input_records"] // runs[k] for k, v in io.items() if k in times}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
