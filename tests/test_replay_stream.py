"""Strict replay reads sorted lines as a stream, not a group of rows per log and block."""

from nomen.operators import replay


def test_logs_are_streamed(spark):
    events = ["pass", "train_start", "noise", "train_end", "predict_start"]
    rows = [(f"l{k % 7}", k, events[k // 7 % 5], "1", float(k)) for k in range(200)]
    lines = spark.createDataFrame(rows, "app string, line long, event string, pass string, at double")
    found = replay.replay_steps(lines, 50)
    assert "FlatMap" not in found._jdf.queryExecution().toString()  # a call of Python per group took the time
    whole = sorted(map(str, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # blocks go over batches
    try:
        assert sorted(map(str, replay.replay_steps(lines, 50).collect())) == whole and len(whole) == 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
