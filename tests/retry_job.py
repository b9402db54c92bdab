"""Run by test_retries.py in its own process: local[4,3] retries failed tasks."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from vecflow.session import get_spark  # noqa: E402
from vecflow.sinks.report_files import write_report_files  # noqa: E402
from vecflow.sinks.vectors import write_vec3  # noqa: E402
from vecflow.sources import vec3  # noqa: E402
from vecflow.sources.load import read_vec3  # noqa: E402


@F.udf(T.DoubleType())
def fail_first_attempt(x, row):
    # every task's first attempt dies after its first 700 rows
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and row % 1000 == 700:
        raise RuntimeError("injected task failure")
    return x


def main(out: str) -> None:
    spark = get_spark("local[4,3]", shuffle_partitions=4, app="vecflow-retries")
    vec3.register(spark)
    src = spark.range(0, 4000, 1, 4).select(
        fail_first_attempt(F.col("id").cast("double"), F.col("id")).alias("x"),
        (F.col("id") * 2.0).alias("y"), (F.col("id") * 3.0).alias("z"))
    vec_dir = os.path.join(out, "vec3")
    write_vec3(src, vec_dir, max_rows=250)
    back = read_vec3(spark, vec_dir, columns=("x", "y", "z"))
    xs = sorted(r.x for r in back.collect())
    assert xs == [float(i) for i in range(4000)], "vec3 output lost or duplicated rows"
    names = [n for d, _, files in os.walk(vec_dir) for n in files if d.endswith("kind=xyz") and n.startswith("part-")]
    assert len(names) == 16, names  # none of lost attempts

    runs = spark.range(0, 400, 1, 4).select(
        F.format_string("r%03d", "id").alias("job_id"),
        fail_first_attempt(F.col("id").cast("double"), F.col("id") * 10).alias("map_time"))
    rep_dir = os.path.join(out, "reports")
    n = write_report_files(runs, rep_dir, "json")
    files = os.listdir(rep_dir)
    assert n == 400 and sorted(files) == [f"r{i:03d}.json" for i in range(400)], (n, len(files))
    print("RETRIES OK")


if __name__ == "__main__":
    main(sys.argv[1])
