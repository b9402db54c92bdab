"""Sinks: vectors (K1), report files (K2, K3), results table (K4), text export (K5)."""

from vecflow.sinks.export import export_text
from vecflow.sinks.report_files import write_report, write_report_files
from vecflow.sinks.reports import report_records, write_reports
from vecflow.sinks.table import results_table, write_results_table
from vecflow.sinks.vectors import write_vec3, write_vectors

__all__ = ["write_vectors", "write_vec3", "write_report", "write_report_files", "write_reports", "report_records",
           "results_table", "write_results_table", "export_text"]
