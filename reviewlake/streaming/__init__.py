"""Structured Streaming forms of the review."""

from reviewlake.streaming.progress import as_rows, review_job
from reviewlake.streaming.review import (first_deliveries, latest_totals, review_directory, review_stream, run_available,
                                         running_totals, windowed_totals)

__all__ = ["as_rows", "first_deliveries", "latest_totals", "review_directory", "review_job", "review_stream", "running_totals",
           "windowed_totals", "run_available"]
