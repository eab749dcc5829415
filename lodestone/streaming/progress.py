"""Reports of running streams: batches, rows, rates and state, as they come."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls report() with a dictionary at a query's start, at most every `seconds` while it runs, and at its end."""

    def __init__(self, report: Callable[[dict], None], seconds: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self.report, self.seconds, self.clock = report, seconds, clock
        self.last: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.report({"event": "start", "query": str(event.runId)})

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        run = p["runId"]
        self.rows[run] = self.rows.get(run, 0) + p.get("numInputRows", 0)
        if run in self.last and self.clock() - self.last[run] < self.seconds:
            return
        self.last[run] = self.clock()
        state = sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))
        self.report({"event": "progress", "query": run, "batch": p["batchId"], "rows": self.rows[run], "rows_per_second": p.get("processedRowsPerSecond", 0.0), "state_rows": state})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"event": "end", "query": str(event.runId), "rows": self.rows.get(str(event.runId), 0), "error": event.exception})


@contextmanager
def watched(spark: SparkSession, report: Callable[[dict], None], seconds: float = 0.0) -> Iterator[Progress]:
    """All streams of the session that run inside are reported."""
    listener = Progress(report, seconds)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
