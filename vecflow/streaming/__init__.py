"""Structured Streaming: incremental ingest of run reports into ``results``."""

from vecflow.streaming.reports import ingest_reports, report_stream

__all__ = ["ingest_reports", "report_stream"]
