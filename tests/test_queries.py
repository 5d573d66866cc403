import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from aerograph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM read_parquet('{SF}/{p}')")
    return c


def shown(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    if sql := catalogue.oracle_sql().get(name):
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert shown([[row[c] for c in sorted(names)] for row in rows]) == shown([[x[names.index(c)] for c in sorted(names)] for x in r.fetchall()])
    else:
        assert rows


def agree(spark, name, folder, events):
    """A query and its SQL give the same rows, compared as they are, on such events (event_id, ts, user_id, event_type, value)."""
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({events})) TO '{folder}/events.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows], key=str)
    assert want and plain(map(tuple, df.collect())) == plain(want)


def test_times_are_rounded_to_milliseconds(spark, tmp_path):
    at = "TIMESTAMP '1969-12-31 23:59:50' + to_microseconds(i * 1234567 + (i % 3) * 500)"
    agree(spark, "ground_speed", tmp_path, f"SELECT i AS event_id, {at} AS ts, i % 2 AS user_id, 'view' AS event_type, 1.0 AS value FROM range(40) t(i)")


def test_record_fields_beyond_the_ramp_and_at_halves(spark, tmp_path):
    some = "SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 1500 AS user_id, 'view' AS event_type, CASE WHEN i % 7 > 0 THEN (i % 600) * 1.0 END AS value FROM range(20000) t(i)"
    agree(spark, "record_fields", tmp_path, some + " UNION ALL SELECT 646, TIMESTAMP '2024-01-01', 1088, 'view', 560.21")


def test_the_ramp_is_clamped_unless_asked_otherwise(spark):
    from aerograph.functions import scalar as S

    df = spark.createDataFrame([(1.12,), (-0.5,), (0.75,), (None,)], "c double")
    assert [r[0] and r[0][:2] for r in df.select(S.confidence_ramp("c")).collect()] == [(0, 255), (255, 0), (128, 255), None]
    assert [r[0] for r in df.select(S.confidence_ramp("c", clamped=False)["r"]).collect()] == [-61, 255, 128, None]


def test_world_files_of_degrees_beyond_180(spark, tmp_path):
    agree(spark, "world_file_bounds", tmp_path, "SELECT i * 61 AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'view' AS event_type, 1.0 AS value FROM range(-5000, 10000) t(i)")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "n", "lo", "p25", "p50", "p75", "p90", "mean", "hi"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    knn = plan(catalogue.queries()["knn_l2_topk"](spark, SF))
    assert "TakeOrderedAndProject" in knn and "Exchange" not in knn
    frame = plan(catalogue.queries()["frame_footprint"](spark, SF))
    assert "Python" not in frame and "Join" not in frame
    gate = plan(catalogue.queries()["isolation_gate"](spark, SF))
    assert "NestedLoop" not in gate and "Cartesian" not in gate
