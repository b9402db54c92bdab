"""Command line: ``python -m vecflow run ...`` and ``python -m vecflow results ...``.

``run`` takes the reference benchmark's options (same short and long names)
and runs the timed pipeline; ``--json``/``--xml`` name the report files, whose
name without extension is the job id. ``results`` turns a folder of reports
into the results table and can export the sorted report views as text.
"""

from __future__ import annotations

import argparse
import os
import sys

from vecflow.sources.generate import DEFAULT_CORES, MEGA_MULTIPLIER


def run_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecflow run", description="timed vector pipeline")
    p.add_argument("-s", "--src", help="folder or file of planar binary vectors")
    p.add_argument("-g", "--generate", action="store_true", help="generate vectors (wins over --src)")
    p.add_argument("-l", "--lazy", action="store_true", help="no per-phase caching")
    p.add_argument("-d", "--dst", help="write the shifted vectors to <dst>/results")
    p.add_argument("-b", "--blocks", type=int, default=1)
    p.add_argument("-m", "--multiplier", type=int, default=MEGA_MULTIPLIER)
    p.add_argument("-k", "--block_size", type=int, default=1)
    p.add_argument("-n", "--nodes", type=int, default=1)
    p.add_argument("-p", "--nparts", type=int, default=1)
    p.add_argument("-c", "--cores", type=int, default=DEFAULT_CORES)
    p.add_argument("-j", "--json", help="JSON report file (<job_id>.json)")
    p.add_argument("-x", "--xml", help="XML report file (<job_id>.xml)")
    p.add_argument("--functional", action="store_true")
    p.add_argument("--hybrid", action="store_true")
    p.add_argument("--imperative", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--store", choices=("files", "memory", "checkpoint"), help="where eager phases go: files in spark.checkpoint.dir (default), memory or checkpoint")
    p.add_argument("--checkpoint", action="store_true",
                   help="eager phases as reliable checkpoints in spark.checkpoint.dir instead of caches")
    p.add_argument("--disk-only", action="store_true", help="eager phase caches on disk only")
    p.add_argument("--master", default=None, help="Spark master for a local run (default: session's)")
    return p


def results_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecflow results", description="report folder -> results table")
    p.add_argument("reports", help="folder of report files")
    p.add_argument("--format", choices=("json", "xml"), default="json")
    p.add_argument("--layout", choices=("files", "records"), default="files")
    p.add_argument("--out", required=True, help="Parquet path of the results table")
    p.add_argument("--export", choices=("sorted", "sorted_gb", "sum_gb"), help="also export a sorted view")
    p.add_argument("--export-path", help="where to write the exported view")
    p.add_argument("--sep", default="\t", help="field separator of the export (tab or ',')")
    p.add_argument("--master", default=None)
    return p


def _job_from(path: str | None) -> tuple[str | None, str | None]:
    if not path:
        return None, None
    folder, name = os.path.split(path)
    return folder or ".", os.path.splitext(name)[0]


def _session(master: str | None):
    from pyspark.sql import SparkSession

    from vecflow.session import get_spark, ship_package

    if master:
        return get_spark(master)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    return spark


def cmd_run(argv) -> int:
    from pyspark import StorageLevel

    from vecflow.plans.pipeline import run_pipeline

    a = run_parser().parse_args(argv)
    if not a.generate and not a.src:
        run_parser().error("give --generate or --src")
    json_dir, json_job = _job_from(a.json)
    xml_dir, xml_job = _job_from(a.xml)
    spark = _session(a.master)
    run = run_pipeline(
        spark, generate=a.generate, src=a.src, dst=a.dst, lazy=a.lazy, functional=a.functional, hybrid=a.hybrid,
        imperative=a.imperative, blocks=a.blocks, block_size=a.block_size, multiplier=a.multiplier,
        nodes=a.nodes, cores=a.cores, nparts=a.nparts, seed=a.seed, job_id=json_job or xml_job,
        json_dir=json_dir, xml_dir=xml_dir, checkpoint=a.checkpoint,
        storage_level=StorageLevel.DISK_ONLY if a.disk_only else None, store=a.store,
    )
    r = run.result
    print(f"sum of block means: x={r['sum_of_block_means_x']} y={r['sum_of_block_means_y']} "
          f"z={r['sum_of_block_means_z']}")
    print("counts:", run.counts)
    print("seconds:", {k: round(v, 6) for k, v in run.timings.items()})
    return 0


def cmd_results(argv) -> int:
    from vecflow.plans import report_queries as rq
    from vecflow.sinks.export import export_text
    from vecflow.sinks.table import results_table, write_results_table
    from vecflow.sources.reports import read_reports

    a = results_parser().parse_args(argv)
    spark = _session(a.master)
    table = results_table(read_reports(spark, a.reports, a.format, a.layout))
    write_results_table(table, path=a.out)
    if a.export:
        if not a.export_path:
            results_parser().error("--export needs --export-path")
        stored = spark.read.parquet(a.out)
        view = {"sorted": rq.overall_sorted, "sorted_gb": rq.overall_sorted_gb,
                "sum_gb": rq.overall_sum_gb}[a.export](stored)
        export_text(view, a.export_path, sep=a.sep)
    print(f"results table written to {a.out}")
    return 0


def main(argv=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in ("run", "results"):
        print("usage: python -m vecflow {run,results} [options]", file=sys.stderr)
        return 2
    return cmd_run(argv[1:]) if argv[0] == "run" else cmd_results(argv[1:])
