import contextlib
import io
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecflow.functions.ids import dense_index
from vecflow.sinks.report_files import OPTIONAL_DEFAULTS, render_report, report_v1, write_report_files
from vecflow.sinks.table import results_table
from vecflow.sources.reports import RESULT_COLUMNS, read_reports

# reports of this package's own runs: the eager and lazy benchmark runs of round 1, in either layout
BENCH = {"experiment_id": "vecflow-timed-run", "job_id": "bench-eager", "generate": 1, "nodes": 1, "cores": 8, "nparts": 2, "blocks": 1,
         "block_size": 8, "map_time": 1.0713e9, "shift_time": 0.8818e9}
V1 = report_v1({**OPTIONAL_DEFAULTS, **BENCH}, json_name="bench-eager.json")
del V1["results"]["report"]["avgTime"]  # older runs timed no average
V2 = {"experiment": {"id": "vecflow-timed-run"},
      "args": {"src": "/data", "dst": "/out", "cores": "12", "generate": "false", "lazy": "false", "blocks": "4",
               "block_size": "1024", "multiplier": "1048576", "block_size_unit": "MB", "nparts": "4", "size": "1",
               "nodes": "2", "json": "x.json", "xml": "", "functional": "false", "hybrid": "false",
               "imperative": "false"},
      "performance": {"map": "1.5", "shift": "2.25", "average": "0.125", "reduce": "0.01", "overall": "3.885"}}


def _folder(tmp_dir, files):
    d = os.path.join(tmp_dir, "reports")
    os.makedirs(d, exist_ok=True)
    for name, content in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(content if isinstance(content, str) else json.dumps(content, indent=2))
    return d


def test_read_v1_and_v2(spark, tmp_dir):
    d = _folder(tmp_dir, {"bench-eager.json": V1, "run.2.json": V2, "notes.txt": "ignored", "x.xml": "<results/>"})
    rows = {r.job_id: r for r in read_reports(spark, d).collect()}
    assert set(rows) == {"bench-eager", "run.2"}
    a = rows["bench-eager"]
    assert (a.generate, a.nodes, a.cores, a.nparts, a.blocks, a.block_size) == (1, 1, 8, 2, 1, 8)
    assert (a.map_time, a.shift_time, a.avg_time) == (1071300000.0, 881800000.0, 0.0)
    assert a.experiment_id == "vecflow-timed-run" and a.src == "" and a.dst == ""
    b = rows["run.2"]
    assert (b.generate, b.nodes, b.nparts, b.blocks, b.block_size) == (0, 2, 4, 4, 1024)
    assert (b.map_time, b.shift_time, b.avg_time) == (1.5e9, 2.25e9, 0.125e9)
    assert (b.src, b.dst) == ("/data", "/out")


def test_missing_keys_default(spark, tmp_dir):
    d = _folder(tmp_dir, {"m.json": {"results": {"experiment": {}, "config": {"nodes": "3"}, "report": {}}}})
    r = read_reports(spark, d).first()
    assert (r.experiment_id, r.nodes, r.cores, r.generate, r.map_time) == ("", 3, 0, 0, 0.0)
    assert (r.src, r.dst) == ("0", "0")  # the reference's default 0 stored as text


def test_bad_number_fails(spark, tmp_dir):
    d = _folder(tmp_dir, {"bad.json": {"results": {"experiment": {"id": "e"}, "config": {"nodes": "many"},
                                                   "report": {}}}})
    with pytest.raises(PySparkException):
        read_reports(spark, d).collect()


def test_write_read_roundtrip_json_and_xml(spark, tmp_dir):
    runs = spark.createDataFrame(
        [("e", 1, 4, 12, 4, 8, 1024, 3e9, 4e9, 1e9, f"j{i}", "", "out", 1 + i % 2) for i in range(20)],
        "experiment_id string, generate int, nodes int, cores int, nparts int, blocks int, block_size int, "
        "map_time double, shift_time double, avg_time double, job_id string, src string, dst string, v int")
    for fmt in ("json", "xml"):
        d = os.path.join(tmp_dir, fmt)
        assert write_report_files(runs, d, fmt, version="v") == 20
        assert len(os.listdir(d)) == 20
        back = read_reports(spark, d, fmt)
        cols = [c for c in RESULT_COLUMNS if c != "id"]
        assert sorted(back.select(*cols).collect()) == sorted(runs.select(*cols).collect())


def test_xml_layout_v2():
    text = render_report({"experiment_id": "e", "job_id": "1", "map_time": 2e9, "dst": "d"}, "xml", 2)
    assert text.startswith("<results>\n  <experiment id=\"e\"/>\n  <args>")
    assert '<property key="block_size" value="1" unit="MB"/>' in text
    assert '<property key="dst" value="d"/>' in text  # real dst (the reference wrote src here)
    assert '<time id="map" t="2.0" unit="s"/>' in text
    assert '<time id="overall" t="2.0" unit="s"/>' in text


def test_results_table_ids(spark, tmp_dir):
    d = _folder(tmp_dir, {f"{j}.json": V1 for j in ("b", "a", "c")})
    t = results_table(read_reports(spark, d))
    assert t.columns == RESULT_COLUMNS
    assert sorted((r.id, r.job_id) for r in t.collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 10000, 1, 13).select((F.col("id") * 7919 % 10007).alias("k"))
    out = dense_index(df, ["k"], name="i")
    rows = sorted((r.i, r.k) for r in out.collect())
    assert [i for i, _ in rows] == list(range(10000))
    assert [k for _, k in rows] == sorted(k for _, k in rows)


def test_native_writer_roundtrip_and_layout(spark, tmp_dir):
    from vecflow.sinks.reports import write_reports

    runs = spark.createDataFrame(
        [("e", i % 2, 4, 12, 4, 8, 64 * (i + 1), 3e9, 4.5e9, 1e9, f"j{i}", "", "out", 1 + i % 2) for i in range(6)],
        "experiment_id string, generate int, nodes int, cores int, nparts int, blocks int, block_size int, "
        "map_time double, shift_time double, avg_time double, job_id string, src string, dst string, v int")
    cols = [c for c in RESULT_COLUMNS if c != "id"]
    for fmt in ("json", "xml"):
        d = os.path.join(tmp_dir, "native-" + fmt)
        write_reports(runs, d, fmt, version="v")
        back = read_reports(spark, d, fmt, layout="records")
        assert sorted(back.select(*cols).collect()) == sorted(runs.select(*cols).collect())
    d = os.path.join(tmp_dir, "native-json")
    lines = [json.loads(line) for n in sorted(os.listdir(d)) if n.endswith(".json")
             for line in open(os.path.join(d, n)) if line.strip()]
    docs = {doc["job_id"]: doc for doc in lines}
    assert len(docs) == 6
    assert docs["j1"]["performance"]["shift"] == "4.5" and docs["j1"]["args"]["block_size_unit"] == "MB"
    assert docs["j1"]["args"]["generate"] == "true" and "results" not in docs["j1"]
    assert docs["j0"]["results"]["report"]["shiftTime"] == "4.5E9" and "args" not in docs["j0"]


def test_json_report_format():
    text = render_report({"experiment_id": "e", "job_id": "7", "map_time": 1e9}, "json", 2)
    assert text.startswith('{\n  "experiment" : {\n    "id" : "e"\n  },\n  "args" : {')
    assert '"map" : "1.0"' in text and '"block_size_unit" : "MB"' in text


def test_results_table_parquet_pushdown(spark, tmp_dir):
    from vecflow.plans import report_queries as rq
    from vecflow.sinks.table import write_results_table

    d = _folder(tmp_dir, {f"{j}.json": V1 for j in ("a", "b")})
    path = os.path.join(tmp_dir, "results.parquet")
    write_results_table(results_table(read_reports(spark, d)), path=path)
    table = spark.read.parquet(path)
    q = rq.runs_by_nodes(table, 1)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        q.explain("formatted")
    assert "PushedFilters: [IsNotNull(nodes), EqualTo(nodes,1)]" in out.getvalue()
    assert q.count() == 2


# without the average time, as older runs wrote it, and without nparts and dst
V1_XML = "".join(line for line in render_report(BENCH, "xml", 1).splitlines(True) if not any(k in line for k in ('"nparts"', '"dst"', "avgTime")))


def test_xml_v1_sample_with_missing_entries(spark, tmp_dir):
    # the documented v1 sample has no avgTime entry and here lacks nparts and dst
    d = _folder(tmp_dir, {"bench-eager.xml": V1_XML, "other.json": V1})
    r = read_reports(spark, d, "xml").first()
    assert (r.job_id, r.generate, r.nodes, r.blocks, r.block_size, r.nparts) == ("bench-eager", 1, 1, 1, 8, 0)
    assert (r.map_time, r.shift_time, r.avg_time) == (1071300000.0, 881800000.0, 0.0)
    assert (r.src, r.dst) == ("", "0")


def test_json_numbers_and_booleans_not_quoted(spark, tmp_dir):
    doc = {"experiment": {"id": "e"}, "args": {"cores": 12, "generate": True, "nodes": 4, "block_size": 8},
           "performance": {"map": 1.25, "shift": 2}}
    d = _folder(tmp_dir, {"n.json": doc})
    r = read_reports(spark, d).first()
    assert (r.cores, r.generate, r.nodes, r.block_size) == (12, 1, 4, 8)
    assert (r.map_time, r.shift_time, r.avg_time) == (1.25e9, 2e9, 0.0)


def test_write_report_single_file_and_series(spark, tmp_dir):
    from vecflow.plans import report_queries as rq
    from vecflow.sinks import write_report

    run = spark.createDataFrame([("e", 1, 4, 12, 4, 8, 64, 3e9, 4e9, 1e9)],
                                "experiment_id string, generate int, nodes int, cores int, nparts int, blocks int, "
                                "block_size int, map_time double, shift_time double, avg_time double")
    path = os.path.join(tmp_dir, "logs", "one-run.xml")
    write_report(run, path, "xml")
    assert os.listdir(os.path.dirname(path)) == ["one-run.xml"]
    r = read_reports(spark, os.path.dirname(path), "xml").first()
    assert (r.job_id, r.nodes, r.map_time) == ("one-run", 4, 3e9)
    table = results_table(read_reports(spark, os.path.dirname(path), "xml"))
    pts = rq.scaling_series(table, "strong", "shift_time").collect()
    assert [(p.kind, p.series, p.nodes, p.metric, p.t) for p in pts] == [("strong", 0, 4, "shift_time", 4.0)]


def test_empty_folders(spark, tmp_dir):
    d = _folder(tmp_dir, {"notes.txt": "no reports here"})
    assert read_reports(spark, d).count() == 0
    assert read_reports(spark, d, "xml").count() == 0
    t = results_table(read_reports(spark, d))
    assert t.columns == RESULT_COLUMNS and t.count() == 0


def test_bad_number_fails_without_ansi(spark, tmp_dir):
    d = _folder(tmp_dir, {"bad.json": {"experiment": {"id": "e"}, "args": {"blocks": "12x"}, "performance": {}},
                          "good.json": {"experiment": {"id": "e"}, "args": {"blocks": " 12 "}, "performance": {}}})
    previous = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(PySparkException):
            read_reports(spark, d).collect()
        good = read_reports(spark, d).filter("job_id = 'good'").first()
        assert good.blocks == 12
    finally:
        spark.conf.set("spark.sql.ansi.enabled", previous)


def test_subfolders_are_not_read(spark, tmp_dir):
    # like the reference's directory listing, only the folder's own files count
    d = _folder(tmp_dir, {"top.json": V2})
    os.makedirs(os.path.join(d, "old"))
    with open(os.path.join(d, "old", "nested.json"), "w") as f:
        json.dump(V2, f)
    assert [r.job_id for r in read_reports(spark, d).collect()] == ["top"]


def test_written_property_keys(spark, tmp_dir):
    """The keys of both XML layouts, in both writers, against the documented lists."""
    import re

    from vecflow.sinks.reports import write_reports

    v2 = ["src", "dst", "cores", "generate", "lazy", "blocks", "block_size", "multiplier", "nparts", "size", "nodes", "json", "xml",
          "functional", "hybrid", "imperative"]
    v1 = ["src", "dst", "cores", "generate", "blocks", "blockSize", "nparts", "size", "nodes", "json", "xml"]
    run = spark.createDataFrame([("k", 2e9)], "job_id string, map_time double")
    for version, keys in ((1, v1), (2, v2)):
        text = render_report(BENCH, "xml", version, xml_name="bench-eager.xml")
        assert re.findall(r'<property key="(.*?)"', text) == keys
        d = os.path.join(tmp_dir, f"native{version}")
        write_reports(run, d, "xml", version)
        part = "".join(open(os.path.join(d, n)).read() for n in os.listdir(d) if n.startswith("part-"))
        assert re.findall(r'key="(.*?)"', part) == keys
        # only the file that was written is named
        values = dict(re.findall(r'key="(json|xml)" value="(.*?)"', part)) or dict(re.findall(r'key="(json|xml)"[^>]*?value="(.*?)"', part))
        assert values == {"json": "", "xml": "k.xml"}


@pytest.mark.parametrize("ids", [["a", "a"], ["_hidden"], [".x"], [""], [None], ["x/y"]])
def test_no_report_replaces_or_hides_another(spark, tmp_dir, ids):
    runs = spark.createDataFrame([(i,) for i in ids], "job_id string")
    with pytest.raises(PySparkException, match="job_id"):
        write_report_files(runs, os.path.join(tmp_dir, "out"), "json")
