"""Task attempts as a stream: outcomes by task with state, and counts by time window with late rows left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procloom import workers
from procloom.operators.state import MAX_ATTEMPTS

OUTCOME = "task long, outcome string, n_attempts long"


def outcomes(attempts: DataFrame) -> DataFrame:
    """A row (task, outcome, n_attempts) for each task of a stream (task, attempt, verdict) once it is settled: accepted, failed, or out of attempts. A task's state is one count; later attempts are ignored."""
    workers.ship(attempts.sparkSession)
    most = MAX_ATTEMPTS

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, settled = state.get if state.exists else (0, False)
        out = []
        for verdict in pd.concat(batches).sort_values("attempt")["verdict"]:
            if settled:
                break
            count += 1
            settled = verdict != "RETRY" or count >= most
            if settled:
                out.append((key[0], "ACCEPTED" if verdict == "ACCEPT" else "FAILED", count))
        state.update((int(count), bool(settled)))
        yield pd.DataFrame(out, columns=["task", "outcome", "n_attempts"])

    return attempts.groupBy("task").applyInPandasWithState(update, OUTCOME, "count long, settled boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window_start, event_type, n of a stream (event_id, ts, event_type): repeated events count once, rows later than late are left out."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
