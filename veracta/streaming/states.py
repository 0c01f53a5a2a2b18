"""Review events as streams: corrections, sessions, uploads and jobs.

Times are event times with a watermark, so what a stream gives doesn't depend
on when it runs, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import changes

TTL, RECENT, WAIT = "2 hours", "30 minutes", 110


def dedupe(events: DataFrame, columns: list[str], delay: str = TTL) -> DataFrame:
    """Events whose content (by hash) was not seen within the watermark's delay."""
    keyed = events.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def capture_changes(edits: DataFrame, fields: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Appends what each micro-batch of edits changes in ``fields``. The sink gets the batch's number, to write it once."""
    writer = edits.writeStream.foreachBatch(lambda batch, n: sink(changes(fields, batch), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


SESSION = "sid string, created timestamp, closed timestamp, job_id string, reason string"
_SESSION_STATE = "created long, job_id string"


def _session(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        created, job = state.get
        ttl = pd.Timedelta(TTL)
        yield pd.DataFrame([(key[0], pd.Timestamp(created, unit="ms"), pd.Timestamp(created, unit="ms") + ttl, job, "expired")], columns=["sid", "created", "closed", "job_id", "reason"])
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    created, job = state.get if state.exists else (None, None)
    for r in rows.itertuples(index=False):
        if r.kind == "create" and created is None:
            created = int(r.ts.timestamp() * 1000)
        elif r.kind == "upload":
            job = r.job_id
    if created is None:  # an upload without a session is nobody's
        return
    state.update((created, job))
    # the watermark may already be past the end
    state.setTimeoutTimestamp(max(created + int(pd.Timedelta(TTL).total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))


def sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``events(sid, kind, job_id, ts)``: each session once, when its time is over, with its latest upload."""
    rows = events.withWatermark("ts", delay).groupBy("sid")
    return rows.applyInPandasWithState(_session, SESSION, _SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions_batch(events: DataFrame, tie: str = "job_id") -> DataFrame:
    """The same over a table: creation, end, and the latest upload within the session; of several at that time, the one
    with the least ``tie``, in whatever order the rows come (the stream keeps the one that comes last)."""
    created = events.where("kind = 'create'").groupBy("sid").agg(F.min("ts").alias("created"))
    closed = F.col("created") + F.expr(f"interval {TTL}")
    ups = events.where("kind = 'upload'").select("sid", "job_id", F.col("ts").alias("at"), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"), F.col(tie).alias("tie")).alias("rank"))
    own = created.join(ups, "sid", "left").where((F.col("at") <= closed) | F.col("at").isNull() | (F.col("at") > closed))
    return own.groupBy("sid", "created").agg(F.min_by("job_id", F.when(F.col("at") <= closed, F.col("rank"))).alias("job_id")).select("sid", "created", closed.alias("closed"), "job_id", F.lit("expired").alias("reason"))


def latest_recent(events: DataFrame, now, window: str = RECENT) -> DataFrame:
    """The latest session with an upload in the time before ``now``."""
    at = F.lit(now).cast("timestamp")
    return events.where((F.col("kind") == "upload") & (F.col("ts") <= at) & (F.col("ts") >= at - F.expr(f"interval {window}"))).agg(F.max_by("sid", F.struct("ts", "sid")).alias("sid"), F.max("ts").alias("ts"))


def matched(session_events: DataFrame, uploads: DataFrame, delay: str = "10 minutes", ttl: str = TTL) -> DataFrame:
    """Stream to stream: sessions with the uploads that come within their time; one without any is given once it is over."""
    s = session_events.withWatermark("created", delay).select("sid", "created")
    u = uploads.withWatermark("ts", delay).select(F.col("sid").alias("u_sid"), "job_id", "ts")
    return s.join(u, F.expr(f"sid = u_sid and ts >= created and ts <= created + interval {ttl}"), "leftOuter").drop("u_sid")


JOB = "job_id string, status string, stage string, ts timestamp"
_JOB_STATE = "status string, stage string, ts long, deadline long"


def job_states(log: DataFrame, wait: int = WAIT, delay: str = "1 minute") -> DataFrame:
    """``log(job_id, kind, line, exit_code, ts)`` with kinds start, line, report and exit: a row whenever a job's status
    changes, and ``timeout`` if it says nothing more for ``wait`` seconds of event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["job_id", "status", "stage", "ts"]
        if state.hasTimedOut:
            _, stage, _, deadline = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "timeout", stage, pd.Timestamp(deadline, unit="ms"))], columns=cols)
            return
        status, stage, last, _ = state.get if state.exists else (None, "", 0, 0)
        out, reported = [], status == "reported"
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            last, before = int(r.ts.timestamp() * 1000), status
            if r.kind == "line" and r.line and r.line.startswith("["):
                stage = r.line
            elif r.kind == "report":
                reported = True
            if r.kind == "exit":
                status = "done" if reported else "error" if r.exit_code else "done_no_report"
            else:
                status = "reported" if reported else "running"
            if status != before and status != "reported":
                out.append((key[0], status, stage, r.ts))
        if status in ("done", "error", "done_no_report"):
            if state.exists:
                state.remove()
        else:
            deadline = max(last + wait * 1000, state.getCurrentWatermarkMs() + 1)
            state.update((status, stage, last, deadline))
            state.setTimeoutTimestamp(deadline)
        if out:
            yield pd.DataFrame(out, columns=cols)

    return log.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(step, JOB, _JOB_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def job_states_batch(log: DataFrame) -> DataFrame:
    """Each job's last status over a table of the same events."""
    kind = F.col("kind")
    ended, code = F.max((kind == "exit").cast("int")), F.max(F.when(kind == "exit", F.col("exit_code")))
    reported = F.max((kind == "report").cast("int"))
    stage = F.max_by(F.when(F.col("line").startswith("["), F.col("line")), F.when(F.col("line").startswith("["), F.col("ts")))
    out = log.groupBy("job_id").agg(ended.alias("e"), code.alias("c"), reported.alias("r"), F.coalesce(stage, F.lit("")).alias("stage"))
    status = F.when(F.col("e") == 0, "running").when(F.col("r") == 1, "done").when(F.coalesce("c", F.lit(0)) != 0, "error").otherwise("done_no_report")
    return out.select("job_id", status.alias("status"), "stage")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_k = 1").drop("_k")
