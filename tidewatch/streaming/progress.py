"""Progress of streams as a table: lag, backlog and state, and which streams stand still."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, batch long, at timestamp, rows long, rows_per_second double, watermark timestamp, state_rows long, state_bytes long, late_rows long, backlog long, millis long, ended boolean, error string"


def _time(text: str | None):
    import datetime

    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(datetime.timezone.utc).replace(tzinfo=None) if text else None


class ProgressTable(StreamingQueryListener):
    """Appends a row for every progress report of the session's streams, and one when a stream ends, to a table under ``path``.

    Rows are written ``every`` so many reports and at an end, as one file each; ``flush`` writes what is left. ``backlog`` is what the sources say they have
    not read yet (offsets or bytes), null where they don't.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every, self.pending, self.names = spark, path, every, [], {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators") or []
        left = [int(v) for s in p.get("sources") or [] for k, v in (s.get("metrics") or {}).items() if k in ("maxOffsetsBehindLatest", "numFilesOutstanding", "numBytesOutstanding")]
        self.names[p["id"]] = p.get("name") or p["id"]
        self._add(
            self.names[p["id"]], p.get("batchId"), _time(p.get("timestamp")), p.get("numInputRows"), float(p.get("processedRowsPerSecond") or 0.0), _time((p.get("eventTime") or {}).get("watermark")),
            sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("memoryUsedBytes", 0) for s in state), sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
            max(left) if left else None, (p.get("durationMs") or {}).get("triggerExecution"), False, None,
        )

    def onQueryTerminated(self, event) -> None:
        self._add(self.names.pop(str(event.id), str(event.id)), None, None, None, None, None, None, None, None, None, None, True, event.exception)
        self.flush()

    def _add(self, *row) -> None:
        self.pending.append(row)
        if len(self.pending) >= self.every:
            self.flush()

    def flush(self) -> None:
        rows, self.pending = self.pending, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def health(progress: DataFrame, as_of, stalled: str = "15 minutes") -> DataFrame:
    """(query, last_at, last_batch, lag_s, state_rows, late_rows, status) of every stream in a progress table.

    ``lag_s`` is how far the watermark is behind ``as_of``. A stream is FAILED if it ended with an error, ENDED if without one, STALLED if it has made no progress for
    ``stalled``, else RUNNING; one that only ended is in the table too.
    """
    now = F.lit(as_of).cast("timestamp")
    last = F.max_by(F.struct("at", "batch", "watermark", "state_rows"), "at")
    g = progress.groupBy("query").agg(last.alias("p"), F.sum("late_rows").alias("late_rows"), F.bool_or("ended").alias("ended"), F.max("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("ended"), "ENDED").when(F.col("p.at") < now - F.expr(f"INTERVAL {stalled}"), "STALLED").otherwise("RUNNING")
    lag = F.unix_timestamp(now) - F.unix_timestamp("p.watermark")
    return g.select("query", F.col("p.at").alias("last_at"), F.col("p.batch").alias("last_batch"), lag.alias("lag_s"), F.col("p.state_rows").alias("state_rows"), "late_rows", status.alias("status"))
