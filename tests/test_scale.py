"""Rewritten plans: results against plain twins, and no task that holds a whole table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerograph.config import DEFAULT
from aerograph.operators import motion as M
from aerograph.operators import retrieval as R
from aerograph.operators import sequences as T


@pytest.mark.parametrize("seed", range(4))
def test_best_rows(spark, seed):
    rng = random.Random(seed)
    value = {0: lambda: rng.uniform(-1, 1), 1: lambda: rng.choice([0.25, -1.0, 1.0]), 2: lambda: rng.gauss(0.5, 1e-9), 3: lambda: round(rng.uniform(-1, 1), 2)}[seed]
    rows = [(i, min(1.0, max(-1.0, value()))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, sim double").repartition(5)
    for k in (1, 17, 900, 2999, 5000):
        got = {r.id for r in R.best(df, "sim", k, "id", bins=16).collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_top_segments(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    words = spark.createDataFrame([("expected", [1.0, 0.0]), ("anomaly", [0.0, 1.0])], "side string, vec array<double>")
    got = [r.vec_id for r in R.top_segments(df, words, 5).collect()]
    every = sorted(R.score_segments(df, words).collect(), key=lambda r: (-r.score, r.vec_id))
    assert got == [r.vec_id for r in every[:5]] and len(every) > 5
    assert R.top_segments(df, words.filter("side = 'expected'")).count() == 0
    with pytest.raises(ValueError):
        R.top_segments(df, words.crossJoin(spark.range(R.MAX_TERMS)).select("side", "vec"))


def test_thresholds_of_long_series(spark):
    rng = random.Random(2)
    rows = [(1, f, 32.0 + (0 if f < 3 else rng.random() * 1e-3), 34.8) for f in range(400)]
    df = spark.createDataFrame(rows, "k long, f long, lat double, lon double")
    ema = 0.0
    for r in sorted(T.adaptive_thresholds(df, "k", ["f"], 40.0).collect(), key=lambda r: r.seq):
        if r.shift_m is None:
            assert r.threshold == DEFAULT.initial_threshold
            continue
        ema = r.shift_m if ema == 0 else 0.4 * r.shift_m + 0.6 * ema
        assert r.ema_m == pytest.approx(ema, rel=1e-12, abs=1e-12)
        assert r.threshold == pytest.approx(max(0.5, min(0.95, 1 - max(0.1, 0.5 * ema / 40))), abs=1e-12)


def plain_spread(g, c, alt, heights):
    """Variances height by height."""
    out = (math.inf, 0.0)
    for h in heights:
        use = (alt > h) & (alt > 0)
        if use.sum() >= 3:
            w = c[use] + (g[use] - c[use]) * ((alt[use] - h) / alt[use])[:, None]
            out = min(out, (math.sqrt(w.var(0).sum()), h), key=lambda r: r[0])
    return out


def test_least_spread(spark):
    rng = np.random.default_rng(5)
    rows = []
    for track in range(12):
        n = int(rng.integers(4, 60))
        cam, alt = rng.normal(0, 50, (n, 2)), rng.uniform(20, 90, n)
        height = float(rng.uniform(0, 15))
        top = np.array([5.0, -3.0]) + rng.normal(0, 0.2, (n, 2)) + (np.arange(n)[:, None] * 0.4 if track % 3 == 0 else 0)
        geo = cam + (top - cam) * (alt / (alt - height))[:, None]
        rows.append((track, geo, cam, alt))
    flat = [(t, float(a), *map(float, (*c, *g))) for t, gs, cs, al in rows for g, c, a in zip(gs, cs, al)]
    df = spark.createDataFrame(flat, "track_id long, alt_m double, cam_e double, cam_n double, geo_e double, geo_n double").repartition(4)
    got = {r.track_id: r for r in T.world_fixed(df).collect()}
    for t, g, c, alt in rows:
        if len(alt) < DEFAULT.wf_min_frames:
            assert t not in got and M.spread(g, c, alt, DEFAULT) == (math.inf, 0.0)
            continue
        top = 0.95 * alt.max()
        step = top / (DEFAULT.wf_scan - 1)
        rough = plain_spread(g, c, alt, np.linspace(0, top, DEFAULT.wf_scan))
        fine = plain_spread(g, c, alt, np.linspace(max(0.0, rough[1] - step), min(top, rough[1] + step), DEFAULT.wf_fine))
        want = fine if fine[0] < rough[0] else rough
        assert M.spread(g, c, alt, DEFAULT) == pytest.approx(want, rel=1e-6)
        assert (got[t].spread_m, got[t].height_m) == pytest.approx(want, rel=1e-6)


def plain_tracks(rows):
    """The greedy tracker, track by track; rows of one label in time order."""
    hav = lambda a, b, c, d: 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    tracks, out = [], {}
    for ts, frame, det, lat, lon in sorted(rows):
        chosen = None
        for t in tracks:
            if frame in t["frames"]:
                continue
            dt = (ts - t["ts"]) / 1000
            away = hav(t["lat"] + t["vlat"] * dt, t["lon"] + t["vlon"] * dt, lat, lon)
            speed = math.hypot(t["vlat"] * 111_320, t["vlon"] * 111_320 * math.cos(math.radians(t["lat"])))
            gate = 5 + (30 if t["hits"] < 2 else 1.5 * speed) * abs(dt)
            if away < gate and (chosen is None or away < chosen[0]):
                chosen = (away, t)
        if chosen is None:
            tracks.append({"frames": set(), "hits": 0, "vlat": 0.0, "vlon": 0.0, "n": len(tracks) + 1})
            t = tracks[-1]
        else:
            t = chosen[1]
            dt = (ts - t["ts"]) / 1000
            if dt > 0:
                t["vlat"] = 0.6 * (lat - t["lat"]) / dt + 0.4 * t["vlat"]
                t["vlon"] = 0.6 * (lon - t["lon"]) / dt + 0.4 * t["vlon"]
        t |= {"lat": lat, "lon": lon, "ts": ts, "hits": t["hits"] + 1}
        t["frames"].add(frame)
        out[det] = t
    return {d: (t["n"], math.hypot(t["vlat"] * 111_320, t["vlon"] * 111_320 * math.cos(math.radians(t["lat"])))) for d, t in out.items()}


def test_tracks_equal_plain_twin(spark):
    rng, rows = random.Random(3), []
    for mission in range(6):
        for f in range(30):
            for k in range(rng.randrange(0, 5)):
                v = (k - 2) * (mission + 1) * 2.0
                rows.append((mission, rng.choice(["Car", "car", "bus"]), len(rows), f, f * 1000, 32.0 + k * 2e-5 + rng.gauss(0, 3e-6), 34.8 + v * f / 94_000 + (rng.random() < 0.05) * 0.01))
    df = spark.createDataFrame(rows, "mission long, label string, det_id long, frame_seq long, ts_ms long, lat double, lon double").repartition(7)
    got = {r.det_id: (r.track_no, r.speed_ms) for r in T.track_velocity(df.withColumn("label", T.canonical("label")), keys=("mission",)).collect()}
    assert len(got) == len(rows)
    for mission in range(6):
        for label in ("car", "bus"):
            part = [(ts, f, d, lat, lon) for m, name, d, f, ts, lat, lon in rows if m == mission and name.lower() == label]
            for d, (n, speed) in plain_tracks(part).items():
                assert got[d][0] == n and got[d][1] == pytest.approx(speed, rel=1e-9, abs=1e-9)


def plain_motion(frames, match, persist, orphan):
    """frames: {frame: blobs}, associated track by track."""
    live, done, made = [], [], 0
    for f in range(min(frames), max(frames) + 1):
        free = list(frames.get(f, []))
        for t in list(live):
            near = min(((math.hypot(x - t["x"], y - t["y"]), i) for i, (x, y) in enumerate(free)), default=(math.inf, 0))
            if near[0] < match:
                t["x"], t["y"] = free.pop(near[1])
                t |= {"hits": t["hits"] + 1, "last": f, "missed": 0}
            else:
                t["missed"] += 1
                if t["missed"] >= orphan:
                    live.remove(t)
                    done.append(t)
        for x, y in free:
            made += 1
            live.append({"id": made, "x": x, "y": y, "hits": 1, "first": f, "last": f, "missed": 0})
    return sorted((t["id"], t["hits"], t["first"], t["last"], t["hits"] >= persist) for t in done + live)


def test_motion_tracks_equal_plain_twin(spark):
    rng, rows = random.Random(9), []
    for stream in range(5):
        for f in range(60):
            if rng.random() < 0.2:
                continue
            for k in range(rng.randrange(1, 4)):
                rows.append((stream, f, len(rows), 100.0 + (7 * f if k % 2 else 300 - 7 * f) + rng.gauss(0, 2), 200.0 + 5 * k))
    df = spark.createDataFrame(rows, "stream_id long, frame_seq long, det_id long, cx double, cy double").repartition(6)
    got = T.motion_tracks(df, persist=8)
    for stream in range(5):
        frames = {}
        for s, f, _, x, y in rows:
            if s == stream:
                frames.setdefault(f, []).append((x, y))
        assert sorted(tuple(r)[1:] for r in got.filter(F.col("stream_id") == stream).collect()) == plain_motion(frames, 20.0, 8, DEFAULT.orphan_frames)


def test_promoted_tiles_are_foreground(spark):
    tiles = spark.createDataFrame([(1, 10, [5]), (2, 11, [5]), (2, 12, [5, 6]), (3, 13, [5]), (3, 14, None)], "frame_seq long, det_id long, cells array<long>")
    plain = {r.det_id: r.foreground for r in T.novelty(tiles, "cells", "frame_seq", "det_id", 0.6).collect()}
    assert plain == {10: True, 11: False, 12: True, 13: False, 14: True}
    tracks = spark.createDataFrame([(3, 5), (1, 99)], "frame_seq long, cell long")
    assert {r.det_id: r.foreground for r in T.novelty(tiles, "cells", "frame_seq", "det_id", 0.6, tracks).collect()} == plain | {13: True}
    levels = tiles.withColumn("level", F.when(F.col("frame_seq") == 2, 0.5).otherwise(1.01))
    assert {r.det_id: r.foreground for r in T.novelty(levels, "cells", "frame_seq", "det_id", "level").collect()} == plain | {12: False, 13: True}


def test_no_whole_group_in_a_row(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(1, "a", 1, 1, 1, 32.0, 34.8)], "mission long, label string, det_id long, frame_seq long, ts_ms long, lat double, lon double")
    assert "FlatMapGroups" not in plan(T.track_velocity(df))
    obs = spark.createDataFrame([(1, 80.0, 0.0, 0.0, 1.0, 1.0)], "track_id long, alt_m double, cam_e double, cam_n double, geo_e double, geo_n double")
    assert "Python" not in plan(T.world_fixed(obs))


def test_a_changed_gate_shows_in_the_trackers_sql(spark):
    """The SQL twin follows the gate: with another one it gives other tracks."""
    import duckdb

    from aerograph.plans import pipeline_queries as Q

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    show = lambda gate: con.execute(f"WITH {Q.CROSSING}, named AS (SELECT *, lower(label) AS track_label FROM crossing), {Q.tracked('named', 'mission, track_label', gate)} SELECT mission, track_label, max(track_no) FROM tracks GROUP BY ALL ORDER BY ALL").fetchall()
    assert show(5.0) != show(0.5)
