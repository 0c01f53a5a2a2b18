import datetime as dt

import pytest

from veracta.operators import review
from veracta.streaming import states

T0 = dt.datetime(2024, 1, 1, 12)
EVENTS = "sid string, kind string, job_id string, ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over batches of rows, one file each, and gives what it appended."""

    def go(name, batches, schema, make):
        src = f"{tmp_path}/{name}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
            if i == 0:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
                q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
            q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    return go


SESSIONS = [[("a", "create", None, at(0)), ("a", "upload", "j1", at(5)), ("b", "upload", "j9", at(5))], [("a", "upload", "j2", at(30)), ("c", "create", None, at(60))], [("z", "create", None, at(600))], [("y", "create", None, at(601))]]


def test_sessions_end_once_with_their_latest_upload(spark, run):
    got = {r.sid: (r.job_id, r.closed - r.created) for r in run("sessions", SESSIONS, EVENTS, states.sessions)}
    assert got == {"a": ("j2", dt.timedelta(hours=2)), "c": (None, dt.timedelta(hours=2))}
    batch = spark.createDataFrame([r for b in SESSIONS for r in b], EVENTS)
    same = {r.sid: r.job_id for r in states.sessions_batch(batch).collect()}
    assert {k: same[k] for k in got} == {k: v[0] for k, v in got.items()}
    assert states.latest_recent(batch, at(40)).first().sid == "a" and states.latest_recent(batch, at(300)).first().sid is None


LOG = "job_id string, kind string, line string, exit_code int, ts timestamp"
JOBS = [
    [("a", "start", None, None, at(0)), ("b", "start", None, None, at(0)), ("c", "start", None, None, at(0))],
    [("a", "line", "[2] read", None, at(1)), ("a", "report", None, None, at(1.5)), ("b", "line", "[1] x", None, at(1))],
    [("a", "exit", None, 0, at(1.6)), ("b", "exit", None, 2, at(1.6))],
    [("w", "start", None, None, at(30))],
    [("v", "start", None, None, at(31))],
]


def test_job_states(spark, run):
    got = run("jobs", JOBS, LOG, states.job_states)
    seen = {}
    for r in sorted(got, key=lambda r: r.ts):
        seen.setdefault(r.job_id, []).append(r.status)
    assert seen["a"] == ["running", "done"] and seen["b"] == ["running", "error"] and seen["c"] == ["running", "timeout"]
    last = {r.job_id: (r.status, r.stage) for r in states.job_states_batch(spark.createDataFrame([r for b in JOBS for r in b], LOG)).collect()}
    assert last["a"] == ("done", "[2] read") and last["b"][0] == "error" and last["c"][0] == "running"


def test_equal_content_is_sent_once(run):
    rows = [("a", "send", "j", at(0)), ("a", "send", "j", at(1))]
    assert len(run("dedupe", [rows, [("a", "send", "j", at(2)), ("a", "send", "k", at(2))]], EVENTS, lambda s: states.dedupe(s, ["sid", "kind", "job_id"]))) == 2


def test_uploads_find_their_sessions(spark, run, tmp_path):
    def make(stream):
        return states.matched(stream.where("kind = 'create'").selectExpr("sid", "ts as created"), stream.where("kind = 'upload'").select("sid", "job_id", "ts"))

    got = {(r.sid, r.job_id) for r in run("matched", [*SESSIONS, [("z", "upload", "jz", at(620)), ("x", "create", None, at(900))], [("x", "upload", "jx", at(901))], [("w", "create", None, at(902))]], EVENTS, make)}
    assert {("a", "j1"), ("a", "j2"), ("c", None)} <= got and not [s for s, _ in got if s == "b"]


def test_changes_are_captured_once(spark, tmp_path):
    fields = spark.createDataFrame([("d", "a", "c", "1"), ("d", "b", None, "2")], "doc_id string, field string, crop string, value string")
    kinds = "doc_id string, field string, value string, reviewer string, ts long"
    edits = spark.createDataFrame([("d", "a", "9", "r", 1), ("d", "b", "2", "r", 1)], kinds)
    edits.write.json(f"{tmp_path}/edits")

    def sink(df, n):
        df.write.mode("overwrite").json(f"{tmp_path}/log/batch={n}")

    for _ in range(2):
        states.capture_changes(spark.readStream.schema(kinds).json(f"{tmp_path}/edits"), fields, sink, f"{tmp_path}/cp").awaitTermination()
    got = spark.read.json(f"{tmp_path}/log")
    assert [(r.field, r.model_value, r.corrected_value) for r in got.collect()] == [("a", "1", "9")]
    assert review.changes(fields, edits).count() == 1
