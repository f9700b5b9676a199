"""Counters and progress of running jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .text import col


def eta_minutes(completed, total, elapsed_s) -> Column:
    """Minutes left at the pace so far, 1 at least; null before three items or one second, and when done."""
    done, of, secs = col(completed), col(total), col(elapsed_s)
    left = F.greatest(F.lit(1), F.bround((of - done) * secs / done / 60.0).cast("int"))
    return F.when((done >= 3) & (secs >= 1.0) & (of > done), left)


def observed(rows: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation that has the counters once an action ran: no second pass."""
    seen = Observation("counters")
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counters.items()]), seen


class Progress(StreamingQueryListener):
    """Tells ``emit`` of each batch of a streaming query as a dict."""

    def __init__(self, emit: Callable[[dict], None]):
        self.emit = emit

    def onQueryStarted(self, event):
        self.emit({"event": "started", "query": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.emit({"event": "progress", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):
        self.emit({"event": "idle", "query": str(event.id)})

    def onQueryTerminated(self, event):
        self.emit({"event": "ended", "query": str(event.id), "error": event.exception})
