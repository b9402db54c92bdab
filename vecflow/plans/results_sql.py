"""The report views as SQL text over a ``results`` table or view.

Plain Spark SQL with named parameters: the table is ``IDENTIFIER(:results)``, filter
values are bound, never pasted into the text. Where a filter is on a name that the view
computes (``gb`` of F3), the computing select stands inside; where a view gives a base
column's name to something else (``nparts`` of F1), the filter stands inside as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GB = "(CAST(blocks AS BIGINT) * block_size) DIV 1024"
_SIZED = f"""{_GB} AS gb, nodes * cores * nparts AS nparts, nodes, blocks, block_size AS blk_sz,
       map_time / 1E9D AS rdd, shift_time / 1E9D AS rdd_shift, avg_time / 1E9D AS rdd_avg"""
_SECONDS = "map_time / 1E9D AS map_time, shift_time / 1E9D AS shift_time, avg_time / 1E9D AS avg_time"

VIEWS: dict[str, str] = {
    # O1: every run
    "sorted": f"""
SELECT {_SIZED}
FROM (SELECT * FROM IDENTIFIER(:results) ORDER BY nodes, cores, blocks, block_size, job_id, id)""",
    # O2 + F1: the base column nparts is filtered, then its name is reused
    "sorted_gb": f"""
SELECT {_SIZED}
FROM (SELECT * FROM IDENTIFIER(:results) WHERE nparts = :nparts
      ORDER BY {_GB}, nodes, cores, blocks, block_size, job_id, id)""",
    # O3
    "sum_gb": """
SELECT sum_gb, nodes * cores * nparts AS partitions, nodes, blocks, block_size,
       map_time / 1E9D AS map_time_sec, shift_time / 1E9D AS shift_time_sec
FROM (SELECT *, (CAST(nodes AS BIGINT) * blocks * block_size) DIV 1024 AS sum_gb FROM IDENTIFIER(:results)
      ORDER BY sum_gb, nodes, cores, blocks, block_size, job_id, id)""",
    # one weak series
    "weak": f"""
SELECT blocks, nodes, {_SECONDS}
FROM (SELECT * FROM IDENTIFIER(:results) WHERE blocks = :key AND nparts = :nparts ORDER BY nodes, job_id, id)""",
    # one strong series, filtered by the computed gb
    "strong": f"""
SELECT gb, nodes, {_SECONDS}
FROM (SELECT *, {_GB} AS gb FROM IDENTIFIER(:results))
WHERE gb = :key AND nparts = :nparts ORDER BY nodes, job_id, id""",
    # F4, F5
    "by_nodes": "SELECT * FROM IDENTIFIER(:results) WHERE nodes = :nodes",
    "by_blocks_and_size": "SELECT * FROM IDENTIFIER(:results) WHERE blocks = :blocks AND block_size = :block_size",
}


def results_view(spark: SparkSession, view: str, results: str = "results", **parameters) -> DataFrame:
    """A view of VIEWS over the table or view named ``results``; ``parameters`` are its named values."""
    if view not in VIEWS:
        raise ValueError(f"view must be one of {sorted(VIEWS)}, got {view!r}")
    return spark.sql(VIEWS[view], args={"results": results, **parameters})
