"""Sources: generated vectors, planar binary files, run reports."""

from vecflow.sources.generate import MEGA_MULTIPLIER, generate_vectors, uniform_draws
from vecflow.sources.load import load_vectors, read_vec3
from vecflow.sources.reports import RESULTS_SCHEMA, read_reports

__all__ = [
    "MEGA_MULTIPLIER", "generate_vectors", "uniform_draws", "load_vectors", "read_vec3",
    "read_reports", "RESULTS_SCHEMA",
]
