"""K4: the ``results`` table -- flat report rows plus an id counting from 0.

The reference numbers rows in directory-listing order (arbitrary); here ids
follow ``job_id`` order so they are reproducible, and are assigned without
moving every row into one task (see ``functions.ids.dense_index``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from vecflow.functions.ids import dense_index
from vecflow.session import kept_dir
from vecflow.sources.reports import FLAT_COLUMNS, RESULT_COLUMNS


def results_table(reports: DataFrame) -> DataFrame:
    rows = reports.select(*FLAT_COLUMNS)
    return dense_index(rows, ["job_id", "experiment_id"], name="id").select(*RESULT_COLUMNS)


def write_results_table(results: DataFrame, path: str | None = None, table: str | None = None) -> None:
    """Replace the table (drop + create + insert in the reference).

    With ``path`` alone: Parquet in that folder. With ``table``: a table of the session's
    catalog over files in a new folder, under ``path`` if that is given, else the shared
    scratch folder. The rows are written first; only then the name is given to them, so
    a failed write leaves the table as it was, and a query that reads the table while it
    is replaced by itself still sees the old files.
    """
    if table:
        spark = results.sparkSession
        folder = f"{path.rstrip('/')}/{uuid.uuid4().hex[:12]}" if path else kept_dir(spark, "table")
        results.write.parquet(folder)
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": table})
        spark.catalog.createTable(table, path=folder, source="parquet")
    elif path:
        results.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("give a path or a table name")
