"""Jobs as a stream of requests and outcomes, with a time limit that a late outcome can overrule."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = ("completed", "skipped")


def after(status: str | None, message: str | None, event: str) -> tuple[str, str | None, bool] | None:
    """Status, message and whether it was late after an event; None if the event changes nothing.

    A request opens a job once. Completed and skipped jobs stay as they are, failed ones too, unless
    they failed by their time limit and are completed after all.
    """
    if status is None:
        return ("pending", None, False) if event == "submit" else None
    timed_out = status == "failed" and message == "timeout"
    if event == "complete" and status not in CLOSED and (status != "failed" or timed_out):
        return "completed", None, timed_out
    if event == "assign" and status == "pending":
        return "assigned", None, False
    if event in ("fail", "skip", "timeout") and status not in (*CLOSED, "failed"):
        return {"skip": "skipped"}.get(event, "failed"), {"fail": "failed", "timeout": "timeout"}.get(event), False
    return None


class JobLives(StatefulProcessor):
    """The jobs of an owner: rows (job, at milliseconds, number, event) in, a row for each change of state out.

    Every call of the state store is a round trip, so an owner's live jobs are one value, read and
    written once for all of its rows, with one timer for what comes next. The limit is a timer; a row
    that comes later than the limit but before the timer could fire (the watermark lags behind) times
    the job out first. Jobs are forgotten likewise.
    """

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "timer long, jobs array<struct<job: string, status: string, message: string, deadline: long, changes: long>>")

    def _read(self) -> tuple[int | None, dict[str, tuple]]:
        timer, held = self.state.get() or (None, [])
        return timer, {job: tuple(rest) for job, *rest in held}

    def _write(self, had: tuple, timer: int | None, lives: dict[str, tuple], watermark: int) -> None:
        """Stores what is live still, and sees that a timer is there for the first job to time out or be forgotten."""
        closed = (*CLOSED, "failed")
        lives = {job: life for job, life in lives.items() if life[0] not in closed or life[2] + self.keep_ms >= watermark}
        if lives:
            due = min(d + self.keep_ms + 1 if status in closed else d for status, _, d, _ in lives.values())
            if timer is None or due < timer:
                self.handle.registerTimer(timer := due)
        if (timer, lives) != had:
            if lives:
                self.state.update((timer, [(job, *life) for job, life in lives.items()]))
            else:
                self.state.clear()

    def _change(self, lives: dict[str, tuple], job: str, at: int, event: str) -> Iterator[Row]:
        status, message, deadline, changes = lives.get(job, (None, None, None, 0))
        new = after(status, message, event)
        if new is None:
            return
        lives[job] = (new[0], new[1], at + self.limit_ms if status is None else deadline, changes + 1)
        when = datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None)
        yield Row(job=job, change=changes + 1, at=when, status=new[0], message=new[1], late=new[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, lives = self._read()
        had = (timer, dict(lives))
        for row in sorted(rows, key=lambda r: (r.at, r.number)):
            if row.job in lives and row.at > (deadline := lives[row.job][2]):
                yield from self._change(lives, row.job, deadline, "timeout")
                if row.at > deadline + self.keep_ms:
                    del lives[row.job]
            yield from self._change(lives, row.job, row.at, row.event)
        self._write(had, timer, lives, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, lives = self._read()
        had, now = (timer, dict(lives)), timerValues.getCurrentWatermarkInMs()
        for job, (_, _, deadline, _) in had[1].items():
            if deadline <= now:
                yield from self._change(lives, job, deadline, "timeout")
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self._write(had, None if timer == fired else timer, lives, now)


def job_changes(events: DataFrame, limit_seconds: int = 180, keep_seconds: int = 7 * 86400, owner: str = "job") -> DataFrame:
    """A row for every change of a job, of a stream (job string, ts, number, event) with a watermark on ts.

    Events are submit, assign, complete, fail and skip; others, and those of a job that isn't there,
    change nothing. ``keep_seconds`` after its limit a job's state goes, so the store holds the jobs
    of that time only; a completion after that is not known any more. ``owner`` is a column that a
    job's rows agree on: the live jobs of an owner, few for each, share a row of state. Needs the
    RocksDB state store.
    """
    own = F.col(owner).cast("string").alias("owner")
    rows = events.select(own, F.col("job").cast("string").alias("job"), "ts", F.unix_millis("ts").alias("at"), F.col("number").cast("long").alias("number"), "event")
    lives = JobLives(limit_seconds * 1000, keep_seconds * 1000)
    return rows.groupBy("owner").transformWithState(lives, "job string, change long, at timestamp_ntz, status string, message string, late boolean", "Append", "EventTime")
