"""Read a folder of run reports into the flat ``results`` shape.

camelCase keys and times in ns, and v2 with ``experiment``/``args``/
``performance`` at the top level and times in seconds. Both are read with one
superset schema -- no inference pass -- and normalised to nanoseconds.
Missing keys default to 0 (or '' for the experiment id), ``generate`` is 1
only for the text 'true', and text that is not a number fails the job.
A folder's lists of reports (``sinks.report_files``, ``per_folder``) are read like
the reports that they name: the driver lists the lists, tasks open the reports.
``job_id`` is the file name without its extension (one report per file, the
reference layout), or the ``job_id`` carried by each record in record files
written by ``sinks.reports`` (``layout="records"``).
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecflow.functions.report_columns import NS_PER_S, strict_cast
from vecflow.functions.report_layout import LIST, V1_CONFIG, V1_TIMES, V2_ARGS, V2_TIMES
from vecflow.session import bounded_listing

_S = T.StringType()
#: bytes of the reports that a task hands on at a time, about
BATCH_BYTES = 1 << 20
# comments and CDATA are passed over, whatever they hold
_XML_MARKS = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|(?P<alone><results(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?/>)|"
                        r"(?P<open><results(?=[\s>]))|(?P<close></results\s*>)", re.S)


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


JSON_SCHEMA = T.StructType([
    T.StructField("results", T.StructType([
        T.StructField("experiment", _struct("id")),
        T.StructField("config", _struct(*(k for k, _ in V1_CONFIG))),
        T.StructField("report", _struct(*(k for k, _ in V1_TIMES))),
    ])),
    T.StructField("experiment", _struct("id")),
    T.StructField("args", _struct(*V2_ARGS)),
    T.StructField("performance", _struct(*(k for k, _ in V2_TIMES))),
    T.StructField("job_id", _S),  # carried by record files (sinks.reports)
])

_PROPS = T.StructType([T.StructField("property", T.ArrayType(_struct("_key", "_value", "_unit")))])
_TIMES = T.StructType([T.StructField("time", T.ArrayType(_struct("_id", "_t", "_unit")))])
XML_SCHEMA = T.StructType([
    T.StructField("experiment", _struct("_id")),
    T.StructField("config", _PROPS),       # v1
    T.StructField("report", _TIMES),       # v1
    T.StructField("args", _PROPS),         # v2
    T.StructField("performance", _TIMES),  # v2
    T.StructField("job_id", _S),           # carried by record files, as above
])

RESULTS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("experiment_id", _S),
    T.StructField("generate", T.IntegerType()),
    T.StructField("nodes", T.IntegerType()),
    T.StructField("cores", T.IntegerType()),
    T.StructField("nparts", T.IntegerType()),
    T.StructField("blocks", T.IntegerType()),
    T.StructField("block_size", T.IntegerType()),
    T.StructField("map_time", T.DoubleType()),
    T.StructField("shift_time", T.DoubleType()),
    T.StructField("avg_time", T.DoubleType()),
    T.StructField("job_id", _S),
    T.StructField("src", _S),
    T.StructField("dst", _S),
])
RESULT_COLUMNS = [f.name for f in RESULTS_SCHEMA.fields]
FLAT_COLUMNS = RESULT_COLUMNS[1:]  # everything but the id


def _job_id(ext: str, file_name: Column | None = None) -> Column:
    """The record's own ``job_id`` (record files), else the file name without
    its final extension (os.path.splitext of the base name)."""
    name = file_name if file_name is not None else F.col("_metadata.file_name")
    return F.coalesce(F.col("job_id"), F.regexp_replace(name, rf"\.{ext}$", ""))


def _int(c: Column, key: str) -> Column:
    return F.coalesce(strict_cast(c, "int", key), F.lit(0))


def _ns(ns_text: Column, s_text: Column, key: str) -> Column:
    """Nanoseconds from a v1 ns value, else a v2 seconds value, else 0.

    Seconds become whole nanoseconds (the reference times with a ns clock).
    """
    ns = strict_cast(ns_text, "double", key)
    s = F.round(strict_cast(s_text, "double", key) * F.lit(NS_PER_S))
    return F.coalesce(ns, s, F.lit(0.0))


def _flatten(experiment: Column, cfg, times_ns: dict[str, Column], job_id: Column) -> DataFrame:
    """Shared projection to the results columns; ``cfg(v1_key, v2_key)`` gives text."""
    text_or_zero = lambda c: F.coalesce(c, F.lit("0"))  # noqa: E731  (reference default 0 -> '0')
    return [
        F.coalesce(experiment, F.lit("")).alias("experiment_id"),
        F.when(cfg("generate", "generate") == F.lit("true"), 1).otherwise(0).alias("generate"),
        _int(cfg("nodes", "nodes"), "nodes").alias("nodes"),
        _int(cfg("cores", "cores"), "cores").alias("cores"),
        _int(cfg("nparts", "nparts"), "nparts").alias("nparts"),
        _int(cfg("blocks", "blocks"), "blocks").alias("blocks"),
        _int(cfg("blockSize", "block_size"), "block_size").alias("block_size"),
        times_ns["map"].alias("map_time"),
        times_ns["shift"].alias("shift_time"),
        times_ns["average"].alias("avg_time"),
        job_id.alias("job_id"),
        text_or_zero(cfg("src", "src")).alias("src"),
        text_or_zero(cfg("dst", "dst")).alias("dst"),
    ]


def _texts_of(fmt: str):
    """(name, text) of every report of the files (path, content); a list gives those that it names."""
    def run(batches):
        from vecflow.sources.fs import filesystem

        kept, size = [], 0

        def flush():
            names, texts = zip(*kept)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_buffer().to_pybytes()
                folder, name = path.rsplit("/", 1)
                found = [(name, data)]
                if name.endswith(f".{fmt}{LIST}"):
                    files, base = filesystem(folder)
                    found = ((inner.rsplit("/", 1)[1], _content(files, f"{base}/{inner}")) for inner in json.loads(data))
                for name, data in found:
                    for text in _records(data, fmt):
                        kept.append((name, text))
                        size += len(text)
                        if size >= BATCH_BYTES:
                            yield flush()
                            kept, size = [], 0
        if kept:
            yield flush()

    return run


def _content(files, path: str) -> bytes:
    with files.open_input_stream(path, compression=None) as f:
        return f.read()


def _records(data: bytes, fmt: str) -> list[str]:
    """The texts to parse of a file: the JSON document, in any encoding of JSON, or each ``results`` element."""
    if fmt == "json":
        return [data.decode(json.detect_encoding(data))] if data.strip() else []
    text, out, start = data.decode("utf-8-sig", errors="replace"), [], None
    for m in _XML_MARKS.finditer(text):
        if start is None and m["alone"]:
            out.append(m[0])
        elif start is None and m["open"]:
            start = m.start()
        elif start is not None and m["close"]:
            out.append(text[start:m.end()])
            start = None
    if start is not None:
        out.append(text[start:])  # cut off: fails when it is parsed
    return out


def report_texts(raw: DataFrame, fmt: str) -> DataFrame:
    """(name, text) of the reports in files read whole as ``value``, batch or stream."""
    # read whole as text and passed on as the file's bytes
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    return files.mapInArrow(_texts_of(fmt), "name string, text string")


def _whole_files(reader, path: str, fmt: str) -> DataFrame:
    return report_texts(reader.format("text").option("wholetext", True).option(
        "pathGlobFilter", f"*.{{{fmt},{fmt}{LIST}}}").load(path), fmt)


def parsed_json(texts: DataFrame) -> DataFrame:
    """Reports of ``report_texts``; a file that holds an array gives each of its items."""
    # FAILFAST: a text that is no JSON fails the job
    items = F.from_json("text", T.ArrayType(JSON_SCHEMA), {"mode": "FAILFAST"})
    return texts.select("name", F.inline(items))


def read_reports_json(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    if layout not in ("files", "records"):
        raise ValueError("layout is 'files' (one report per file) or 'records' (JSON lines)")
    with bounded_listing(spark):
        if layout == "files":
            return normalise_json(parsed_json(_whole_files(spark.read, path, "json")), F.col("name"))
        raw = (
            spark.read.schema(JSON_SCHEMA)
            .option("mode", "FAILFAST")
            .option("pathGlobFilter", "*.json")
            .json(path)
        )
    return normalise_json(raw)


def normalise_json(raw: DataFrame, file_name: Column | None = None) -> DataFrame:
    """Flat results columns (no id) from JSON reports read with ``JSON_SCHEMA``."""

    def cfg(v1: str, v2: str) -> Column:
        return F.when(F.col("results").isNotNull(), F.col(f"results.config.{v1}")).otherwise(F.col(f"args.{v2}"))

    def t(v1: str, v2: str) -> Column:
        is_v1 = F.col("results").isNotNull()
        return _ns(
            F.when(is_v1, F.col(f"results.report.{v1}")),
            F.when(~is_v1, F.col(f"performance.{v2}")),
            v1,
        )

    experiment = F.when(F.col("results").isNotNull(), F.col("results.experiment.id")).otherwise(
        F.col("experiment.id"))
    times = {"map": t("mapTime", "map"), "shift": t("shiftTime", "shift"), "average": t("avgTime", "average")}
    return raw.select(*_flatten(experiment, cfg, times, _job_id("json", file_name)))


def read_reports_xml(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    # values are kept as written, like the JSON reader
    options = {"rowTag": "results", "ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}
    file_name = None
    with bounded_listing(spark):
        if layout == "files":
            texts = _whole_files(spark.read, path, "xml")
            raw = texts.select("name", F.from_xml("text", XML_SCHEMA, options).alias("r")).select("name", "r.*")
            file_name = F.col("name")
        else:
            raw = spark.read.format("xml").schema(XML_SCHEMA).options(**options).option("pathGlobFilter", "*.xml").load(path)
    is_v1 = F.col("config").isNotNull() | F.col("report").isNotNull()
    props = F.when(is_v1, F.col("config.property")).otherwise(F.col("args.property"))
    times = F.when(is_v1, F.col("report.time")).otherwise(F.col("performance.time"))
    raw = raw.select(
        F.col("experiment._id").alias("experiment"),
        F.map_from_entries(F.transform(props, lambda p: F.struct(p["_key"], p["_value"]))).alias("cfg"),
        times.alias("times"),
        _job_id("xml", file_name).alias("_job"),
        is_v1.alias("_v1"),
    )

    def cfg(v1: str, v2: str) -> Column:
        return F.when(F.col("_v1"), F.col("cfg")[v1]).otherwise(F.col("cfg")[v2])

    def t(v1: str, v2: str) -> Column:
        wanted = F.when(F.col("_v1"), F.lit(v1)).otherwise(F.lit(v2))
        # get(): NULL (then 0) when the report has no such entry, also under ANSI mode
        entry = F.get(F.filter("times", lambda e: e["_id"] == wanted), 0)
        value = strict_cast(entry["_t"], "double", v1)
        unit = F.coalesce(entry["_unit"], F.when(F.col("_v1"), F.lit("ns")).otherwise(F.lit("s")))
        ns = F.when(unit == "s", F.round(value * F.lit(NS_PER_S))).otherwise(value)
        return F.coalesce(ns, F.lit(0.0))

    times_ns = {"map": t("mapTime", "map"), "shift": t("shiftTime", "shift"), "average": t("avgTime", "average")}
    return raw.select(*_flatten(F.col("experiment"), cfg, times_ns, F.col("_job")))


def read_reports(spark: SparkSession, path: str, fmt: str = "json", layout: str = "files") -> DataFrame:
    """Flat report rows (results columns without ``id``) from a folder.

    ``layout="files"``: one report per file (the reference's folders);
    ``"records"``: record files from ``sinks.reports.write_reports`` (read as files, XML
    record files give the same rows, each file by one task at once).
    """
    if fmt == "json":
        return read_reports_json(spark, path, layout)
    if fmt == "xml":
        return read_reports_xml(spark, path, layout)
    raise ValueError(f"unknown report format {fmt!r}")
