"""Stateful streams: idempotent jobs, circuits, and windowed counts (an extension)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def deduplicated(jobs: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first job of a key within the time that late rows are waited for (QUE-01)."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, late: str, window: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


class Circuit(StatefulProcessor):
    """Failures in a row of each provider, across batches; a success resets them (QUE-07)."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of the rows seen so far only the failures after the last success are held.
        since, last = pd.Series(dtype="int64"), None
        for part in rows:
            good = part.loc[~part["failed"], "event_id"]
            last = last if good.empty else int(good.max()) if last is None else max(last, int(good.max()))
            since = pd.concat([since, part.loc[part["failed"], "event_id"]])
            since = since if last is None else since[since > last]
        before = self.failures.get()[0] if self.failures.exists() else 0
        n = len(since) + (before if last is None else 0)
        self.failures.update((n,))
        yield pd.DataFrame({"provider": [key[0]], "failures": [n], "open": [n >= self.threshold]})

    def close(self) -> None:
        pass


def circuits(outcomes: DataFrame, threshold: int) -> DataFrame:
    """``provider, failures, open`` after each batch of ``outcomes(provider, event_id, failed)``."""
    return outcomes.groupBy("provider").transformWithStateInPandas(
        statefulProcessor=Circuit(threshold), outputStructType="provider long, failures long, open boolean", outputMode="update", timeMode="none"
    )


LEASED = "job_id long, status string, attempt_count int, max_attempts int, cancel_requested boolean, next_attempt_at timestamp, lease_expires_at timestamp"


class Leases(StatefulProcessor):
    """A job between claims and outcomes; a timer at the end of its lease recovers it (QUE-03, QUE-04).

    The state of a job is one row. Each lease has a timer in event time: when the watermark passes it, the job is
    cancelled, dead or to be tried again, whether or not anything more is heard of it.
    """

    def __init__(self, base: int, longest: int):
        self.base, self.longest = base, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, most int, cancel boolean, next long, lease long")

    def _read(self) -> dict:
        names = ("status", "attempts", "most", "cancel", "next", "lease")
        return dict(zip(names, self.job.get() if self.job.exists() else ("queued", 0, 1, False, None, None)))

    def _backoff_ms(self, attempts: int) -> int:
        return 1000 * int(min(self.longest, self.base * 2.0 ** (attempts - 1)))

    def _recover(self, job: dict, at: int) -> None:
        if job["status"] == "running" and job["lease"] is not None and job["lease"] <= at:
            job["status"] = "cancelled" if job["cancel"] else "dead_letter" if job["attempts"] >= job["most"] else "retry"
            job["next"], job["lease"] = at + self._backoff_ms(job["attempts"]), None

    def _apply(self, job: dict, kind: str, at: int, lease: int | None, most: int | None) -> None:
        if kind == "claim":
            if job["status"] in ("queued", "retry") and not job["cancel"]:
                job |= {"status": "running", "attempts": job["attempts"] + 1, "most": job["most"] if most is None else most, "lease": lease}
        elif kind == "request_cancel":
            job["cancel"] = True
        elif kind == "retry":
            job |= {"status": "queued", "next": at, "lease": None}
        elif job["status"] == "running":
            if kind == "heartbeat":
                job["lease"] = lease
            elif kind == "cancel" or job["cancel"]:
                job |= {"status": "cancelled", "lease": None}
            elif kind == "complete":
                job |= {"status": "completed", "lease": None}
            elif kind == "fail":
                dead = job["attempts"] >= job["most"]
                job |= {"status": "dead_letter" if dead else "retry", "next": at + self._backoff_ms(job["attempts"]), "lease": None}

    def _row(self, key, job: dict) -> pd.DataFrame:
        time = lambda ms: pd.Series([None if ms is None else pd.Timestamp(ms, unit="ms")], dtype="datetime64[ns]")
        return pd.DataFrame({"job_id": [key[0]], "status": [job["status"]], "attempt_count": [job["attempts"]], "max_attempts": [job["most"]], "cancel_requested": [job["cancel"]], "next_attempt_at": time(job["next"]), "lease_expires_at": time(job["lease"])})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = self._read()
        before = job["lease"]
        every = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        for kind, at, lease, most in zip(every["kind"], every["at_ms"], every["lease_ms"], every["max_attempts"]):
            self._recover(job, int(at))
            self._apply(job, kind, int(at), None if pd.isna(lease) else int(lease), None if pd.isna(most) else int(most))
        if job["lease"] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if job["lease"] is not None:
                self.handle.registerTimer(job["lease"])
        self.job.update(tuple(job.values()))
        yield self._row(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        if job["status"] == "running" and job["lease"] is not None and job["lease"] <= now:
            self._recover(job, now)
            self.job.update(tuple(job.values()))
            yield self._row(key, job)

    def close(self) -> None:
        pass


def leases(events: DataFrame, base: int, longest: int, late: str = "0 seconds") -> DataFrame:
    """The state of each job that a batch of events changes, and of each whose lease ends meanwhile.

    Events: event_id, job_id, kind (claim, heartbeat, complete, fail, cancel, request_cancel, retry), at, lease (when
    it ends), max_attempts. Those of a job are applied by time, then id; rows later than ``late`` are dropped by the
    watermark. A lease that has ended counts from its end, so what is said of the job afterwards finds it recovered.
    """
    ms = lambda c: F.unix_millis(c)
    rows = events.withWatermark("at", late).select("event_id", "job_id", "kind", "at", ms("at").alias("at_ms"), ms("lease").alias("lease_ms"), "max_attempts")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Leases(base, longest), outputStructType=LEASED, outputMode="update", timeMode="eventTime")


def refresh(changes: DataFrame, apply, checkpoint: str):
    """Apply each batch of changes to a snapshot as it arrives."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: apply(batch)).start()
