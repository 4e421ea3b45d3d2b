"""Streaming ingest of report files dropped into a landing folder."""

from rmalytics.streaming.report_stream import report_stream

__all__ = ["report_stream"]
