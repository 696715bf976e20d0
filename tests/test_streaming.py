from __future__ import annotations

from datetime import datetime

from procloom.operators import state
from procloom.streaming import tasks


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def test_outcomes_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(t, a, "ACCEPT" if (t + a) % 4 == 0 else "FAIL" if (t * a) % 7 == 6 else "RETRY", None) for t in range(20) for a in range(1, 5)]
    df = spark.createDataFrame(rows, "task long, attempt int, verdict string, category string")
    for k in range(1, 5):  # attempts come one after the other, in files of their own
        df.where(f"attempt = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {tuple(r) for r in drain(tasks.outcomes(stream), "outcomes_table").collect()}
    wanted = {(r["task"], r["outcome"], r["n_attempts"]) for r in state.task_outcomes(df).where("outcome <> 'PENDING'").collect()}
    assert found == wanted


def test_windows_count_each_event_once_and_leave_late_rows_out(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    parts = [
        [(1, at(8, 5), "a"), (2, at(8, 50), "a"), (1, at(8, 5), "a"), (3, at(8, 59), "b")],
        [(4, at(9, 10), "a"), (2, at(8, 50), "a"), (5, at(8, 58), "b")],  # a repeat, and one that comes in time
        [(6, at(12, 0), "a")],  # the watermark goes to 11:50
        [(7, at(9, 0), "a"), (8, at(12, 30), "b")],  # too late
        [(9, at(15, 0), "a")],
    ]
    for rows in parts:
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {(r["window_start"], r["event_type"], r["n"]) for r in drain(tasks.windowed(stream), "windows_table").collect()}
    assert found == {(at(8), "a", 2), (at(8), "b", 2), (at(9), "a", 1), (at(12), "a", 1), (at(12), "b", 1)}
