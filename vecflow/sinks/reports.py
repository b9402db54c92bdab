"""K2/K3 with Spark's own writers: report structs built from run rows with
built-in expressions and written by the JSON or XML data source as record
files -- one JSON line or one ``<results>`` element per run, many runs per
file, each record carrying its ``job_id``. No Python runs in the tasks, and a
campaign of millions of runs does not turn into millions of files.

Layout v2 (what the reference writes today) or v1 (the documented older
layout), chosen per writer call or per row. ``read_reports(..., layout=
"records")`` reads them back; the reference's one-file-per-run folders are
written by ``sinks.report_files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecflow.functions.report_columns import NS_PER_S
from vecflow.functions.report_layout import V1_CONFIG, V1_TIMES, V1_XML_CONFIG, V2_ARGS, V2_TIMES, V2_XML_ARGS
from vecflow.sinks.report_files import OPTIONAL_DEFAULTS

#: records of a file, at most: XML files are read whole, each by one task (about 1 KB a record)
FILE_RECORDS = 1 << 14
FLAGS = ("generate", "lazy", "functional", "hybrid", "imperative")


def _filled(df: DataFrame) -> DataFrame:
    cols = {}
    for k, v in OPTIONAL_DEFAULTS.items():
        cols[k] = F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v)
    out = df.withColumns(cols)
    return out.withColumn(
        "overall_time", F.col("map_time") + F.col("shift_time") + F.col("avg_time") + F.col("reduce_time"))


def _values(ext: str) -> dict[str, Column]:
    """Text of every report value, as the reference writes them."""
    v = {}
    for k in ("src", "dst"):
        v[k] = F.col(k).cast("string")
    for k in ("cores", "blocks", "block_size", "multiplier", "nparts", "size", "nodes"):
        v[k] = F.col(k).cast("bigint").cast("string")
    for k in FLAGS:
        v[k] = F.when(F.col(k).cast("int") != 0, F.lit("true")).otherwise(F.lit("false"))
    v["block_size_unit"] = F.lit("MB")
    for k in ("json", "xml"):  # a record names only the file that is written
        v[k] = F.concat(F.col("job_id").cast("string"), F.lit(f".{k}")) if k == ext else F.lit("")
    for name, c in V2_TIMES:
        v[f"s:{name}"] = (F.col(c) / F.lit(NS_PER_S)).cast("string")
    for name, c in V1_TIMES:
        v[f"ns:{name}"] = F.col(c).cast("double").cast("string")
    return v


def _json_columns(v: dict[str, Column]) -> dict[str, Column]:
    return {
        "v2_experiment": F.struct(F.col("experiment_id").alias("id")),
        "v2_args": F.struct(*[v[k].alias(k) for k in V2_ARGS]),
        "v2_performance": F.struct(*[v[f"s:{n}"].alias(n) for n, _ in V2_TIMES]),
        "v1_results": F.struct(
            F.struct(F.col("experiment_id").alias("id")).alias("experiment"),
            F.struct(*[v[src].alias(key) for key, src in V1_CONFIG]).alias("config"),
            F.struct(*[v[f"ns:{n}"].alias(n) for n, _ in V1_TIMES]).alias("report"),
        ),
    }


def _props(pairs, v) -> Column:
    return F.struct(F.array(*[
        F.struct(F.lit(key).alias("_key"), v[src].alias("_value"),
                 (F.lit("MB") if key == "block_size" else F.lit(None).cast("string")).alias("_unit"))
        for key, src in pairs]).alias("property"))


def _times(pairs, v, unit: str) -> Column:
    prefix = "s:" if unit == "s" else "ns:"
    return F.struct(F.array(*[
        F.struct(F.lit(n).alias("_id"), v[prefix + n].alias("_t"), F.lit(unit).alias("_unit"))
        for n, _ in pairs]).alias("time"))


def _xml_columns(v: dict[str, Column]) -> dict[str, Column]:
    return {
        "experiment": F.struct(F.col("experiment_id").alias("_id")),
        "v1_config": _props(V1_XML_CONFIG, v),
        "v1_report": _times(V1_TIMES, v, "ns"),
        "v2_args": _props([(k, k) for k in V2_XML_ARGS], v),
        "v2_performance": _times(V2_TIMES, v, "s"),
    }


def report_records(df: DataFrame, fmt: str = "json", version: int | str = 2) -> DataFrame:
    """One report struct row per run row (plus ``job_id``), ready for the writer."""
    if "job_id" not in df.columns:
        raise ValueError("run rows need a job_id column")
    ver = F.col(version).cast("int") if isinstance(version, str) else F.lit(int(version))
    base = _filled(df)
    v = _values(fmt)
    cols = _json_columns(v) if fmt == "json" else _xml_columns(v)
    is_v1 = ver == 1

    def pick(name: str, want_v1: bool) -> Column:
        return F.when(is_v1 if want_v1 else ~is_v1, cols[name])

    if fmt == "json":
        out = [pick("v1_results", True).alias("results"), pick("v2_experiment", False).alias("experiment"),
               pick("v2_args", False).alias("args"), pick("v2_performance", False).alias("performance")]
    elif fmt == "xml":
        out = [cols["experiment"].alias("experiment"), pick("v1_config", True).alias("config"),
               pick("v1_report", True).alias("report"), pick("v2_args", False).alias("args"),
               pick("v2_performance", False).alias("performance")]
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return base.select(*out, F.col("job_id").cast("string").alias("job_id"))


def write_reports(df: DataFrame, path: str, fmt: str = "json", version: int | str = 2,
                  mode: str = "overwrite") -> str:
    """Write every run's report as a record (with its ``job_id``) into part files of FILE_RECORDS at most."""
    writer = report_records(df, fmt, version).write.mode(mode).format(fmt).option("maxRecordsPerFile", FILE_RECORDS)
    if fmt == "xml":
        writer = writer.option("rowTag", "results").option("rootTag", "reports")
    writer.save(path)
    return path
