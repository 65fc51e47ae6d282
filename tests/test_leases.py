"""Leases as a stream: equal to the batch functions on the same log, and timers that fire without input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terravane.operators import queue
from terravane.streaming import jobs

EVENT = "event_id long, job_id long, kind string, at timestamp, lease timestamp, max_attempts int"
T0 = dt.datetime(2024, 1, 1)


def minute(n):
    return T0 + dt.timedelta(minutes=n)


@pytest.fixture
def run(spark, tmp_path):
    """Files of events, one micro-batch each, to the last state of every job."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def over(*files):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        seen = []
        query = jobs.leases(stream, 60, 3600).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, i: seen.extend(b.collect())).start()
        query.awaitTermination()
        return {r["job_id"]: r for r in seen}, seen

    yield over
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_the_batch_functions_on_the_same_log(spark, run):
    """Nine jobs are claimed, some hear an outcome, the others only the watermark; one is asked to be cancelled."""
    claims = [(i, i, "claim", minute(0), minute(30 if i != 8 else 300), 1 if i in (2, 6) else 3) for i in range(9)]
    outcomes = [(100 + i, i, kind, minute(10), minute(200) if kind == "heartbeat" else None, None) for i, kind in ((0, "complete"), (1, "fail"), (2, "fail"), (3, "cancel"), (4, "heartbeat"), (7, "request_cancel"))]
    clock = [(999, 50, "claim", minute(60), minute(600), 3)]
    last, _ = run(claims, outcomes, clock)
    running = [(i, "running", 1, 1 if i in (2, 6) else 3, i == 7, None, minute(300 if i == 8 else 30)) for i in range(9)]
    frame = spark.createDataFrame(running, jobs.LEASED)
    said = spark.createDataFrame([(i, k, minute(10), e) for _, i, k, _, e, _ in outcomes if k != "request_cancel"], "job_id long, outcome string, at timestamp, lease timestamp")
    # The timer of a lease recovers at its end, so the batch asks at that time.
    want = queue.recovered(queue.after_outcome(frame, said, 60, 3600), F.lit(minute(30)), 60, 3600).collect()
    for r in want:
        got = last[r["job_id"]]
        assert (got["status"], got["attempt_count"], got["lease_expires_at"]) == (r["status"], r["attempt_count"], r["lease_expires_at"] if r["status"] == "running" else None), r
        if r["status"] in ("retry", "dead_letter"):
            assert got["next_attempt_at"] == r["next_attempt_at"]
    assert {i: last[i]["status"] for i in range(9)} == {0: "completed", 1: "retry", 2: "dead_letter", 3: "cancelled", 4: "running", 5: "retry", 6: "dead_letter", 7: "cancelled", 8: "running"}


def test_an_outcome_after_the_lease_finds_the_job_recovered(run):
    last, _ = run([(1, 1, "claim", minute(0), minute(5), 3)], [(2, 1, "complete", minute(6), None, None), (3, 2, "claim", minute(6), minute(9), 3)])
    assert last[1]["status"] == "retry" and last[1]["next_attempt_at"] == minute(6) + dt.timedelta(seconds=60)


def test_a_heartbeat_moves_the_timer(run):
    """The old end of the lease passes without effect, the new one is kept; a second claim counts another attempt."""
    last, seen = run([(1, 1, "claim", minute(0), minute(5), 3)], [(2, 1, "heartbeat", minute(4), minute(20), None)], [(3, 2, "claim", minute(10), minute(99), 3)], [(4, 1, "fail", minute(15), None, None)], [(5, 1, "claim", minute(18), minute(40), None)])
    assert [r["status"] for r in seen if r["job_id"] == 1] == ["running", "running", "retry", "running"]
    assert last[1]["attempt_count"] == 2 and last[1]["max_attempts"] == 3 and last[1]["lease_expires_at"] == minute(40)
