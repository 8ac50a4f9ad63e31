"""The host guard and run counters on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crawl import assess

ATTEMPTS = "host string, seq long, attempt int, status int, retry_after double, challenge boolean"
VERDICTS = "host string, seq long, attempt int, status int, action string, reason string, wait double"
_STATE = "stopped string, limited int, streak int"


def guarded(attempts: DataFrame) -> DataFrame:
    """VERDICTS for a stream of ATTEMPTS: the same as crawl.guard() on all of them, if a host's attempts come in the order of seq.

    Kept per host: why it was stopped, 429s so far, server errors in a row. Inside a micro-batch attempts are
    ordered by seq, whatever the order of their rows. A null status is a network error.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, 0, 0)
        now = (now[0] or None, int(now[1]), int(now[2]))
        rows = pd.concat(list(batches)).sort_values(["seq", "attempt"])
        out = []
        for r in rows.itertuples():
            status = 0 if pd.isna(r.status) else int(r.status)
            asked = None if pd.isna(r.retry_after) else float(r.retry_after)
            challenge = not pd.isna(r.challenge) and bool(r.challenge)
            now, action, reason, wait = assess(now, status, int(r.attempt), asked, challenge)
            out.append((key[0], int(r.seq), int(r.attempt), status, action, reason, wait))
        state.update((now[0] or "", now[1], now[2]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])
        yield frame.astype({"wait": "float64"})

    return attempts.groupBy("host").applyInPandasWithState(follow, VERDICTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def counters(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """start, event, n: events (ts timestamp, event) counted per time window; a window is given once its time and the lateness have passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")
