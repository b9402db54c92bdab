"""K5: export a query result as delimited text with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vecflow.functions.ids import dense_index
from vecflow.session import remove_scratch, scratch_dir


#: bytes that the joining of parts holds
COPY_BYTES = 1 << 20


def export_text(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> str:
    """Tab (default) or comma separated text with a header, one file per partition.

    Part files keep the DataFrame's order when it is sorted; no single-task
    ``coalesce(1)``.
    """
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)
    return path


def read_text(spark, path: str, schema, sep: str = "\t"):
    """Read an export back with its schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def export_file(df: DataFrame, path: str, order_by, sep: str = "\t") -> str:
    """One text file with one header line and the rows in order, as a database shell writes it.

    All tasks write their ranges of the sorted rows as headerless parts; the parts' names
    follow the order. They are then joined on the shared file system: by its own
    concatenation where it has one (HDFS: metadata only), else by copying bytes through a
    small buffer. The finished file takes its name last.
    """
    spark = df.sparkSession
    # a range sort that is stored: each part file holds one range, named by its number
    parts = scratch_dir(spark, "export")
    df.orderBy(*order_by).write.option("header", False).option("sep", sep).csv(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    goal, temp = hadoop(path), hadoop(f"{parts}/_joined")
    fs = temp.getFileSystem(conf)
    listed = sorted(str(f.getPath().toString()) for f in fs.listStatus(hadoop(parts))
                    if f.getPath().getName().startswith("part-") and f.getLen())
    head = bytearray((sep.join(df.columns) + "\n").encode())
    out = fs.create(temp, True)
    out.write(head, 0, len(head))
    if fs.getScheme() == "hdfs" and listed:
        out.close()
        names = spark.sparkContext._gateway.new_array(hadoop, len(listed))
        for k, name in enumerate(listed):
            names[k] = hadoop(name)
        fs.concat(temp, names)
    else:
        for name in listed:
            part = fs.open(hadoop(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, COPY_BYTES, False)
            part.close()
        out.close()
    aim = goal.getFileSystem(conf)
    if aim.getUri().equals(fs.getUri()):
        aim.delete(goal, False)
        if not fs.rename(temp, goal):
            raise OSError(f"{path} could not be written")
    else:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, temp, aim, goal, True, True, conf)
    remove_scratch(spark, parts)
    return path


def with_position(df: DataFrame, order_by, name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in a total order: makes an order part of the result (no single-task window)."""
    return dense_index(df, order_by, name=name, start=1, as_int=False)
