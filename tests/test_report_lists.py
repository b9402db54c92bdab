import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecflow.plans.catalog import QUERIES
from vecflow.sinks.report_files import render_report, write_report_files
from vecflow.sinks.reports import write_reports
from vecflow.sources.reports import _records, read_reports

from conftest import SF_SMALL


def _runs(spark, n):
    return spark.range(n).select(F.lit("e").alias("experiment_id"), (F.col("id") + 1).cast("int").alias("nodes"),
                                 (F.col("id") * 1e9).alias("map_time"), F.format_string("j%03d é", "id").alias("job_id"))


@pytest.mark.parametrize("fmt", ["json", "xml"])
def test_listed_reports_are_all_read(spark, tmp_dir, fmt):
    assert write_report_files(_runs(spark, 50), tmp_dir, fmt, per_folder=8) == 50
    files = [n for _, _, names in os.walk(tmp_dir) for n in names if n.endswith(f".{fmt}")]
    assert len(files) == len(set(files)) == 50  # a file for each run
    seen = [n for n in os.listdir(tmp_dir) if n[0] not in "._"]
    assert 1 < len(seen) <= 7 and all(n.endswith(f".{fmt}list") for n in seen)
    # a report beside the lists is read too
    with open(os.path.join(tmp_dir, f"other.{fmt}"), "w") as f:
        f.write(render_report({"job_id": "other", "nodes": 51, "map_time": 50e9}, fmt, 1))
    back = read_reports(spark, tmp_dir, fmt)
    assert len(back.inputFiles()) == len(seen) + 1  # all that the driver lists
    assert sorted((r.job_id, r.nodes, r.map_time) for r in back.collect()) == sorted(
        [(f"j{i:03d} é", i + 1, i * 1e9) for i in range(50)] + [("other", 51, 50e9)])


@pytest.mark.parametrize("name", ["reports_flatten", "report_xml"])
def test_queries_leave_reports_to_the_tasks(spark, name):
    back = QUERIES[name](spark, SF_SMALL)
    assert back.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert len(back.inputFiles()) == 1


@pytest.mark.parametrize("ids", [["a", "a"], ["_hidden"], [None], ["x/y"]])
def test_listed_reports_replace_or_hide_none(spark, tmp_dir, ids):
    runs = spark.createDataFrame([(i,) for i in ids], "job_id string")
    with pytest.raises(PySparkException, match="job_id"):
        write_report_files(runs, tmp_dir, per_folder=8)


def test_odd_report_files(spark, tmp_dir):
    one, two = ({"experiment": {"id": x}, "args": {"nodes": "3"}} for x in ("é", "b"))
    for name, data in (("array", json.dumps([one, two]).encode()), ("wide", json.dumps(one, ensure_ascii=False).encode("utf-16")),
                       ("marked", json.dumps(one, ensure_ascii=False).encode("utf-8-sig")), ("empty", b"")):
        with open(os.path.join(tmp_dir, f"{name}.json"), "wb") as f:
            f.write(data)
    assert sorted((r.job_id, r.experiment_id, r.nodes) for r in read_reports(spark, tmp_dir).collect()) == [
        ("array", "b", 3), ("array", "é", 3), ("marked", "é", 3), ("wide", "é", 3)]


def test_records_of_an_xml_file(spark, tmp_dir):
    assert _records(b"<a><!-- <results> --><results/><results x='>'>1</results> <results><![CDATA[</results>]]></results></a>", "xml") == [
        "<results/>", "<results x='>'>1</results>", "<results><![CDATA[</results>]]></results>"]
    d = os.path.join(tmp_dir, "records")
    write_reports(_runs(spark, 20), d, "xml")
    assert sorted(r.job_id for r in read_reports(spark, d, "xml").collect()) == [f"j{i:03d} é" for i in range(20)]


def test_record_files_are_bounded(spark, tmp_dir):
    from vecflow.sinks.reports import FILE_RECORDS

    write_reports(_runs(spark, 2 * FILE_RECORDS + 1).coalesce(1), tmp_dir, "xml")
    assert len([n for n in os.listdir(tmp_dir) if n.startswith("part-")]) == 3
    assert read_reports(spark, tmp_dir, "xml", "records").select("job_id").distinct().count() == 2 * FILE_RECORDS + 1
