from vecflow.plans import report_queries as rq

COLS = ("id int, experiment_id string, generate int, nodes int, cores int, nparts int, blocks int, "
        "block_size int, map_time double, shift_time double, avg_time double, job_id string, src string, dst string")


def _results(spark):
    rows = [
        (0, "e", 1, 1, 12, 12, 1000, 1000, 2e9, 3e9, 1e9, "a", "", ""),
        (1, "e", 1, 4, 12, 4, 1000, 1000, 1e9, 2e9, 5e8, "b", "", ""),
        (2, "e", 1, 4, 12, 4, 2000, 100, 4e9, 5e9, 6e9, "c", "", ""),
        (3, "e", 1, 16, 12, 4, 3, 1000, 1e9, 1e9, 1e9, "d", "", ""),
    ]
    return spark.createDataFrame(rows, COLS)


def test_overall_sorted_integer_gb_and_order(spark):
    out = rq.overall_sorted(_results(spark)).collect()
    assert [r.nodes for r in out] == [1, 4, 4, 16]
    assert out[0].gb == (1000 * 1000) // 1024 and out[0].nparts == 1 * 12 * 12
    assert out[3].gb == 2  # 3000 div 1024, not 2.93
    assert out[0].rdd == 2.0 and out[0].rdd_avg == 1.0


def test_sorted_gb_filters_base_nparts(spark):
    out = rq.overall_sorted_gb(_results(spark)).collect()
    # rows with base nparts = 4 (the computed alias nparts = 48 or 192 does not shadow it)
    assert len(out) == 3
    assert [r.gb for r in out] == sorted(r.gb for r in out)


def test_sum_gb_and_filters(spark):
    out = rq.overall_sum_gb(_results(spark)).collect()
    assert [r.sum_gb for r in out] == [46, 781, 976, 3906]  # (nodes*blocks*block_size) div 1024, sorted
    assert [r.partitions for r in out] == [768, 192, 144, 192]
    assert rq.runs_by_nodes(_results(spark), 16).count() == 1
    assert rq.runs_by_blocks_and_size(_results(spark)).count() == 2


def test_distinct(spark):
    assert [r.blocks for r in rq.distinct_blocks(_results(spark)).collect()] == [3, 1000, 2000]
    assert [r.gb for r in rq.distinct_gb(_results(spark)).collect()] == [2, 195, 976]


def test_series_and_points(spark):
    weak = rq.weak_series(_results(spark)).collect()
    assert [(r.blocks, r.nodes) for r in weak] == [(3, 16), (1000, 4), (2000, 4)]
    assert weak[2].avg_time == 6.0  # avg_time itself, not shift_time
    strong = rq.strong_series(_results(spark)).collect()
    assert [r.gb for r in strong] == [2, 195, 976]
    one = rq.series_for(_results(spark), "strong", 976).collect()
    assert len(one) == 1 and one[0].nodes == 4
    pts = rq.scaling_points(_results(spark))
    assert pts.count() == 3 * 3 * 2
    assert rq.scaling_points(_results(spark), metric="avg_time").count() == 6


def test_one_configuration_sorts_in_many_tasks(spark):
    """Runs that are equal in all published sort keys must not end up in one task."""
    from pyspark.sql import functions as F

    same = spark.range(0, 20_000, 1, 8).selectExpr(
        "cast(id as int) id", "'e' experiment_id", "1 generate", "4 nodes", "12 cores", "4 nparts", "48 blocks", "128 block_size",
        "1e9 map_time", "2e9 shift_time", "3e9 avg_time", "concat('j', id) job_id", "'' src", "'' dst")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q in (rq.overall_sorted, rq.overall_sorted_gb, rq.overall_sum_gb, rq.weak_series, rq.strong_series):
            per = [r["count"] for r in q(same).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per) == 20_000 and max(per) < 10_000, (q.__name__, per)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_file_keeps_order_over_partitions(spark, tmp_dir):
    import os

    from vecflow.sinks.export import export_file

    df = spark.range(0, 5000, 1, 7).selectExpr("cast(pmod(xxhash64(id), 100000) as int) k", "id", "concat('t', id) name")
    path = os.path.join(tmp_dir, "one.tsv")
    for _ in range(2):  # the second replaces the first
        export_file(df, path, ["k", "id"])
        want = "k\tid\tname\n" + "".join(f"{r.k}\t{r.id}\t{r.name}\n" for r in sorted(df.collect()))
        with open(path, newline="") as f:
            assert f.read() == want
    export_file(df.limit(0), path, ["k"], sep=",")
    with open(path) as f:
        assert f.read() == "k,id,name\n"


def test_catalog_table_is_replaced_whole(spark, tmp_dir):
    import pytest

    from vecflow.sinks.table import write_results_table

    one, two = spark.range(5).withColumnRenamed("id", "a"), spark.range(9).selectExpr("id b", "'x' c")
    write_results_table(one, path=tmp_dir, table="vf_replaced")
    assert spark.table("vf_replaced").count() == 5
    write_results_table(two, path=tmp_dir, table="vf_replaced")
    assert spark.table("vf_replaced").columns == ["b", "c"] and spark.table("vf_replaced").count() == 9
    # from itself, and a failed write that leaves the table as it was
    write_results_table(spark.table("vf_replaced").where("b < 4"), path=tmp_dir, table="vf_replaced")
    with pytest.raises(Exception):
        write_results_table(spark.range(3).selectExpr("assert_true(id < 2) a"), path=tmp_dir, table="vf_replaced")
    assert spark.table("vf_replaced").count() == 4
    spark.sql("DROP TABLE vf_replaced")


def test_sql_views_bind_their_values(spark):
    import pytest

    from vecflow.plans.results_sql import results_view

    spark.createDataFrame([(1, 2, 1024, 4)], "nodes int, blocks int, block_size int, nparts int").createOrReplaceTempView("vf_runs")
    assert results_view(spark, "by_nodes", "vf_runs", nodes=1).count() == 1
    assert results_view(spark, "by_blocks_and_size", "vf_runs", blocks=2, block_size=5).count() == 0
    with pytest.raises(ValueError):
        results_view(spark, "other", "vf_runs")
