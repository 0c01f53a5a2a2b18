"""The registered queries against the SQL that is registered with them, where the driver's tables are there."""

import datetime as dt
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veracta.functions import dates
from veracta.operators import review
from veracta.plans import catalogue, records  # noqa: F401

TABLES = Path("/root/testdata/sf0.001")
SAMPLE = ("consensus_report", "confusion_prf", "wide_export", "dedupe_corrections", "country_detect", "lev_metrics", "name_split", "stem_prefix", "numeric_dates", "words_to_int", "rule_findings", "gap_cluster", "ols_interpolate", "range_join", "last_write_wins", "declaration_map", "quality_metrics", "job_status", "session_ttl", "json_repair_stages")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not TABLES.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(TABLES))
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = df.select(*cols).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", ["record_rules", "record_places", "record_scores", "record_report", "work_list", "shown_values", "available_crops", "refined_boxes"])
def test_records_and_lists_are_their_sql(spark, duck, name):
    test_query_is_its_sql(spark, duck, name)


def test_every_query_without_sql_runs(spark, duck):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, str(TABLES)).count() > 0, name


@pytest.mark.parametrize("name", ["dates_in_text", "dedupe_corrections"])
def test_whole_forms_are_their_sql(spark, duck, name):
    test_query_is_its_sql(spark, duck, name)


def test_dates_of_every_form_are_looked_for(spark, duck):
    """Against a scan in Python, with years whose last two digits can be a day."""
    days = [dt.date(y, m, d) for y in (1992, 1998, 2005, 2012, 2031) for m in (1, 2, 12) for d in (1, 9, 28, 31) if (m, d) != (2, 31)]
    texts = [d.strftime(f) for d in days for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "le %d.%m.%y")]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", dates.dates_in_text(F.col("s")).alias("d")).collect()
    for r in got:
        assert r.d == [d for m in dates._NUMERIC.finditer(texts[r.i]) if (d := dates._in_digits(m))], texts[r.i]
    n = duck.execute("select count(*) from orders").fetchone()[0]
    assert catalogue.QUERIES["dates_in_text"](spark, str(TABLES)).count() == n


def test_pages_have_every_word(spark, duck):
    want = duck.execute(r"select sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) from benchmark").fetchone()[0]
    page = catalogue._page(spark, str(TABLES))
    assert page.select(F.sum(F.size("words"))).first()[0] == want
    found = catalogue.QUERIES["grounding_audit"](spark, str(TABLES)).collect()
    assert len(found) == page.count() and {r.status for r in found} >= {"verified", "missing_from_response", "dropped_sanity", "dropped_contradicted"}


def test_corrections_that_differ_late_are_two(spark):
    rows = spark.createDataFrame([(1, 1, "the same first words a", "the same first words b"), (2, 1, "the same first words a", "the same first words c")], "doc_id int, turn int, value string, new string")
    got = review.corrections_quality(catalogue._corrections(rows)).first()
    assert (got.reviewed, got.wrong, got.docs_touched) == (2, 2, 2)


def test_uploads_at_one_time_in_any_order_of_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    t = dt.datetime(2024, 1, 1)
    events = [(i, t, i, "signup") for i in range(40)] + [(100 + 1000 * k + i, t + dt.timedelta(minutes=5), i, "click") for i in range(40) for k in (0, 1, 2, 10)]
    events = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string")
    for name, order in (("up", "event_id"), ("down", F.desc("event_id")), ("mixed", F.xxhash64("event_id"))):
        events.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = {r.sid: r.job_id for r in catalogue.QUERIES["session_ttl"](spark, f"{tmp_path}/{name}").collect()}
        assert got == {str(i): str(100 + i) for i in range(40)}, name
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view events as select * from '{tmp_path}/up/events.parquet/*.parquet'")
    assert {r[0]: r[3] for r in con.execute(catalogue.ORACLE_SQL["session_ttl"]).fetchall()} == got
