"""Column expressions (JVM-side, codegen'd) used by the operators."""

from vecflow.functions.ids import dense_index
from vecflow.functions.random import uniform_double
from vecflow.functions.report_columns import (
    data_gb,
    ns_to_s,
    strict_cast,
    sum_gb,
    total_partitions,
)
from vecflow.functions.vectors import array_add, array_scale

__all__ = [
    "uniform_double",
    "array_add",
    "array_scale",
    "data_gb",
    "sum_gb",
    "total_partitions",
    "ns_to_s",
    "strict_cast",
    "dense_index",
]
