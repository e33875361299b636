"""What a streaming query reports about itself."""

from __future__ import annotations

from typing import Any

from pyspark.sql.streaming import StreamingQuery


def progress_report(query: StreamingQuery) -> list[dict[str, Any]]:
    """Rows, duration, state size and late rows of the recent micro-batches.

    Spark keeps a bounded number of them (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    report = []
    for progress in query.recentProgress:
        operators = progress["stateOperators"]
        report.append(
            {
                "batch_id": progress["batchId"],
                "input_rows": progress["numInputRows"],
                "duration_ms": progress["durationMs"].get("triggerExecution"),
                "watermark": progress["eventTime"].get("watermark"),
                "state_rows": sum(op["numRowsTotal"] for op in operators),
                "late_rows_dropped": sum(op["numRowsDroppedByWatermark"] for op in operators),
            }
        )
    return report
