"""The job table as a fold of events, in batch and as a keyed stream.

An event is (workflow_key, ts, kind, job_id, payload): claim asks for a job on a key, and
start, heartbeat, complete and fail report on one. At most one job a key is active. A claim
on a key with an active job attaches to it, unless it was silent for longer than the stale
threshold: then it is failed and superseded by the new one. Events of a job that has ended
are ignored, and an event that comes late does not set a job's time back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEARTBEAT, STALE = timedelta(seconds=300), timedelta(seconds=900)
RETRY, JITTER, DEADLINE = timedelta(seconds=120), timedelta(seconds=30), timedelta(seconds=14_400)
ADMITTED = 1024
KEEP_FOR = timedelta(days=7)
JOB = "workflow_key string, job_id string, status string, active boolean, submitted_at timestamp, updated_at timestamp, superseded_by string, error string"


class KeyState:
    """Jobs of one key; only the newest can be active."""

    def __init__(self, jobs: list[dict] | None = None, stale: timedelta = STALE) -> None:
        self.jobs, self.stale = jobs or [], stale

    def apply(self, key: str, ts: pd.Timestamp, kind: str, job_id: str, error: str | None = None) -> None:
        last = self.jobs[-1] if self.jobs else None
        if kind == "claim":
            if last and last["active"]:
                if ts - last["updated_at"] <= self.stale:
                    return
                last |= {"status": "failed", "active": False, "updated_at": ts, "superseded_by": job_id, "error": "stale: reclaimed by a later request"}
            self.jobs.append({"workflow_key": key, "job_id": job_id, "status": "pending", "active": True, "submitted_at": ts, "updated_at": ts, "superseded_by": None, "error": None})
            return
        job = last if last and last["job_id"] == job_id else None  # only the newest can be active
        if job is None or not job["active"]:
            return
        if kind == "start" and job["status"] != "pending":
            return
        status = {"start": "running", "complete": "completed", "fail": "failed"}.get(kind, job["status"])
        job |= {"status": status, "active": status in ("pending", "running"), "updated_at": max(ts, job["updated_at"]), "error": error if kind == "fail" else job["error"]}

    def forget(self, keep: timedelta = KEEP_FOR) -> None:
        """Drop ended jobs that were last touched longer ago than keep before the newest one; events of ended jobs do nothing anyway."""
        newest = max((j["updated_at"] for j in self.jobs), default=None)
        self.jobs = [j for j in self.jobs if j["active"] or newest - j["updated_at"] <= keep]


_COLUMNS = [x.strip().split(" ")[0] for x in JOB.split(",")]


def _whole(events: DataFrame) -> DataFrame:
    """Events without time, kind or job say nothing and are left out."""
    return events.select("workflow_key", "ts", "kind", "job_id", "payload").where(F.col("ts").isNotNull() & F.col("kind").isNotNull() & F.col("job_id").isNotNull())


def fold_jobs(events: DataFrame, stale: timedelta = STALE) -> DataFrame:
    """The job table after all events, in order of ts by key.

    Events come sorted from the shuffle and go through the state machine one after another;
    of a key only the newest job is held, as the others cannot change any more, so a key may
    have any number of events and jobs.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = KeyState(stale=stale), None
        for frame in frames:
            done: list[dict] = []
            for e in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if e.workflow_key != key:
                    done += state.jobs
                    state, key = KeyState(stale=stale), e.workflow_key
                state.apply(key, e.ts, e.kind, e.job_id, e.payload)
                if len(state.jobs) > 1:
                    done += state.jobs[:-1]
                    del state.jobs[:-1]
            yield pd.DataFrame(done, columns=_COLUMNS)
        yield pd.DataFrame(state.jobs, columns=_COLUMNS)

    order = [F.col(c).asc_nulls_last() for c in ("workflow_key", "ts", "job_id", "kind")]
    return _whole(events).repartition("workflow_key").sortWithinPartitions(*order).mapInPandas(fold, JOB)


def job_stream(events: DataFrame, stale: timedelta = STALE) -> DataFrame:
    """The jobs that each micro-batch of a stream of events changes, state kept by key (update mode)."""
    columns = _COLUMNS
    state_schema = f"jobs array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in JOB.split(','))}>>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = [dict(zip(columns, j, strict=True)) for j in state.get[0]] if state.exists else []
        for j in old:
            j["submitted_at"], j["updated_at"] = pd.Timestamp(j["submitted_at"]), pd.Timestamp(j["updated_at"])
        before = {j["job_id"]: dict(j) for j in old}
        keyed = KeyState(old, stale)
        for e in pd.concat(list(frames)).sort_values(["ts", "job_id", "kind"], kind="stable").itertuples():
            keyed.apply(key[0], e.ts, e.kind, e.job_id, e.payload)
        changed = [j for j in keyed.jobs if j != before.get(j["job_id"])]
        keyed.forget()
        state.update(([tuple(j[c].to_pydatetime() if isinstance(j[c], pd.Timestamp) else j[c] for c in columns) for j in keyed.jobs],))
        yield pd.DataFrame(changed, columns=columns).astype({"superseded_by": object, "error": object})

    keyed = _whole(events).groupBy("workflow_key")
    return keyed.applyInPandasWithState(step, JOB, state_schema, "update", "NoTimeout")


def active_jobs(jobs: DataFrame) -> DataFrame:
    """(active_jobs, admitted): how many jobs are active, and whether one more may be."""
    n = F.count(F.when(F.col("active"), 1))
    return jobs.agg(n.alias("active_jobs"), (n < ADMITTED).alias("admitted"))


def heartbeat_gaps(events: DataFrame, key: str, ts: str, gap: timedelta = STALE) -> DataFrame:
    """(key, session_start, last_seen, beats): spans of events of a key no further apart than gap."""
    s = F.session_window(ts, f"{int(gap.total_seconds())} seconds")
    return events.groupBy(key, s.alias("s")).agg(F.max(ts).alias("last_seen"), F.count("*").alias("beats")).select(key, F.col("s.start").alias("session_start"), "last_seen", "beats")


def stale_jobs(jobs: DataFrame, now, threshold: timedelta = STALE) -> DataFrame:
    """Active jobs that were silent for longer than the threshold."""
    return jobs.where(F.col("active") & (F.col("updated_at") < F.lit(now - threshold)))


def requeue_orphans(jobs: DataFrame, now, threshold: timedelta = STALE) -> DataFrame:
    """Jobs with running ones that were silent for too long set back to pending."""
    orphan = (F.col("status") == "running") & (F.col("updated_at") < F.lit(now - threshold))
    return jobs.withColumns({"status": F.when(orphan, F.lit("pending")).otherwise(F.col("status")), "updated_at": F.when(orphan, F.lit(now)).otherwise(F.col("updated_at"))})


def lease_due(jobs: DataFrame, now, n: int = 1) -> DataFrame:
    """The n jobs that are due longest."""
    return jobs.where(F.col("active") & (F.col("next_dispatch_at") <= F.lit(now))).orderBy("next_dispatch_at", "job_id").limit(n)


def next_dispatch(jobs: DataFrame, now) -> DataFrame:
    """Jobs with next_dispatch_at pushed on by the retry interval and a jitter that the job id fixes; those past the deadline fail."""
    late = F.col("submitted_at") < F.lit(now - DEADLINE)
    wait = F.make_dt_interval(secs=F.lit(RETRY.total_seconds()) + F.pmod(F.xxhash64("job_id"), F.lit(int(JITTER.total_seconds()) + 1)))
    return jobs.withColumns({
        "next_dispatch_at": F.when(~late, F.lit(now) + wait),
        "status": F.when(late, F.lit("failed")).otherwise(F.col("status")),
        "active": F.col("active") & ~late,
    })


def expire(jobs: DataFrame, now, keep: timedelta = KEEP_FOR) -> DataFrame:
    """Jobs without the ended ones that were last touched longer ago than keep."""
    return jobs.where(F.col("active") | (F.col("updated_at") >= F.lit(now - keep)))


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    return events.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
