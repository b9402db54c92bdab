"""Vector operators: shift, means, reduce, joins."""

from vecflow.operators.means import (
    block_means,
    choose_method,
    global_mean,
    matrix_means,
    matrix_means_hybrid,
    matrix_sums,
    scale_by_matrix_rows,
    vector_sum_nd,
)
from vecflow.operators.reduce import phase_counts, reduce_block_means
from vecflow.operators.shift import SHIFT, scale, shift, vector_scale, vector_shift

__all__ = [
    "SHIFT", "shift", "vector_shift", "scale", "vector_scale",
    "matrix_sums", "matrix_means", "matrix_means_hybrid", "block_means", "choose_method",
    "global_mean", "scale_by_matrix_rows", "vector_sum_nd",
    "reduce_block_means", "phase_counts",
]
