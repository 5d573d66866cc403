import pytest
from pyspark.sql import functions as F
from aerograph.functions import models
from aerograph.sources import protobuf as P
from aerograph.sources import telemetry as T

SRT = """1
00:00:00,000 --> 00:00:00,100
<font size="28">[latitude: 32.5] [longitude: -34.25] [altitude: 81.5] [gb_yaw: 12.5 gb_pitch: -60.0 gb_roll: 1.0]</font>

2
00:00:01.250 --> 00:00:01.350
GPS (31.5, 35.5, 18), D 5m, H 60.5m, H.S 1.0m/s

x
00:00:02,000 --> 00:00:02,100
[latitude: 1] [longitude: 1]

3
00:00:02,000 --> 00:00:02,100
no position

4
00:00:03,000

5
00:00:04,000 --> 00:00:04,100
[latitude: -1.5] [longitude: 2.5] [rel_alt: 12.0]
"""


def test_srt(spark):
    df = spark.createDataFrame([("a", SRT), ("b", None), ("c", "")], "path string, text string")
    rows = T.parse_srt(df).orderBy("timestamp_ms").collect()
    assert [(r["index"], r.timestamp_ms, r.lat, r.lon, r.alt_m) for r in rows] == [(0, 0, 32.5, -34.25, 81.5), (1, 1250, 31.5, 35.5, 60.5), (4, 4000, -1.5, 2.5, 0.0)]
    assert (rows[0].gimbal_yaw, rows[0].gimbal_pitch, rows[0].gimbal_roll, rows[1].gimbal_pitch) == (12.5, -60.0, 1.0, -90.0)
    assert T.parse_srt(df, rel_alt=True).filter("index = 4").first().alt_m == 12.0


def test_srt_json(spark):
    text = '1\n00:00:00,000 --> 00:00:01,000\n{"lat": 1.5, "note": "x"}\n\n2\n00:00:01,000 --> 00:00:02,000\nplain words\n'
    rows = T.parse_srt_json(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("index").collect()
    assert rows[0].fields == {"lat": "1.5", "note": "x"} and rows[1].fields is None and rows[1].raw_subtitle.strip() == "plain words"


def test_whole_file(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    df = T.load_text(spark, f"file://{tmp_path}/a.srt")
    assert df.count() == 1 and T.parse_srt(df).count() == 3


def test_json_sources(spark):
    one = lambda t: spark.createDataFrame([(t,)], "text string")
    r = T.parse_pose_json(one('{"b": {"full_path": "p", "lat": 0.0, "lon": 1.0, "alt_m": 5.0}, "a": {"lat": 2.0, "lon": 1.0, "z": 3.0}}')).collect()
    assert [(x.frame_name, x.lat, x.z, x.img_w_px, x.flight_yaw) for x in r] == [("a", 2.0, 3.0, 4000, 0.0), ("b", None, 5.0, 4000, 0.0)]
    assert T.parse_pose_json(one("not JSON")).count() == 0 and T.parse_exif_json(one(None)).count() == 0
    e = T.parse_exif_json(one('[{"GPSLatitude": 1, "GPSLongitude": 2, "RelativeAltitude": "+7.5"}, {"GPSLatitude": 1}]')).collect()
    assert [(x.lat, x.lon, x.alt_m, x.gimbal_pitch) for x in e] == [(1, 2, 7.5, -90.0)]


def test_world_file_of_a_known_projection(spark):
    df = spark.createDataFrame([("0.001\n0\n0\n-0.001\n200.0005\n9.9995",)], "text string")
    at = lambda how: [round(x, 6) for x in T.world_file(df, mercator=how).select("north", "west").first()]
    assert at(False) == [10.0, 200.0] and at(True) == at(None) and at(True)[0] < 0.001


def test_world_file(spark):
    r = T.world_file(spark.createDataFrame([("1\n0\n0\n-1\n3896182.5\n3763309.5",)], "text string"), width=100, height=100).first()
    assert 31 < r.south < r.north < 33 and 34 < r.west < r.east < 36


def test_protobuf(spark):
    inner = P.encode([(1, 32.5), (2, 34.25)])
    packet = P.encode([(3, P.encode([(2, inner), (5, 80_000)])), (9, b"junk")])
    assert P.find(packet, (3, 2, 1)) == 32.5 and P.find(packet, (3, 5)) == 80_000 and P.find(packet, (3, 7)) is None
    assert P.decode(b"\xff") == {} and P.zigzag(3) == -2 and P.varint(P.encode_varint(300), 0) == (300, 2)
    df = spark.createDataFrame([(0, packet), (33, b""), (66, None), (99, packet[:6])], "pts_ms long, packet binary")
    rows = P.packets(df, {"lat": (3, 2, 1), "lon": (3, 2, 2), "alt": (3, 5)}).collect()
    assert [(r.pts_ms, r.lat, r.lon, r.alt) for r in rows] == [(0, 32.5, 34.25, 80_000)]


def test_models(spark):
    df = spark.createDataFrame([("t1",), ("t2",), (None,)], "tile string")
    v = models.encode(df, "tile").collect()
    assert abs(sum(x * x for x in v[0].vector) - 1) < 1e-9 and v[2].vector is None and v[0].vector != v[1].vector

    def broken():
        def run(*_):
            raise RuntimeError

        return run

    models.register("broken", broken)
    tiles = spark.range(30).selectExpr("concat('t', id) AS tile")
    found = models.detect(tiles, "tile", "car")
    assert found.count() > 0 and models.detect(tiles, "tile", "car", "broken").count() == 0
    checked = models.verify(found, "tile").collect()
    assert all(r.confirmed == (r.confidence >= 0.5) for r in checked)
    assert not any(r.confirmed for r in models.verify(found, "tile", "broken").collect())


def test_vocabulary_and_segments(spark):
    calls = []

    def backend(scene, hint):
        calls.append(scene)
        if scene == "bad":
            raise RuntimeError
        return {"expected": ["sand"], "anomaly": []}

    v = models.Vocabulary(backend)
    assert v("Beach", "x") == v("beach", "X") == {"expected": ["sand"], "anomaly": ["x"]} and len(calls) == 1
    assert v("bad", "x")["expected"][0] == "bad"
    assert v.frame(spark, "beach", "x").count() == 2
    models.register("regions", lambda: lambda f: [{"box": (0, 0, 30, 30), "area": a, "frame_area": 10_000} for a in (100, 900, 9000)])
    assert [r.area for r in models.segment(spark.createDataFrame([("f",)], "f string"), "f", "regions").collect()] == [900.0]


def test_srt_dialects_stay_apart(spark):
    text = "\n\n".join(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i},100\n{line}" for i, line in enumerate((
        "GPS (32.5, 34.5, 0), D 1.0m [altitude: 70.0]", "GPS (32.5, 34.5, 0), H.S 3.0m/s, H 41.5m", "latitude: 31.0 longitude: 35.0", "[latitude: 31.0] [longitude: 35.0] [altitude: 9.5] H 3m")))
    rows = T.parse_srt(spark.createDataFrame([(text,)], "text string")).orderBy("timestamp_ms").collect()
    assert [(r.lat, r.alt_m) for r in rows] == [(32.5, 0.0), (32.5, 41.5), (31.0, 9.5)]


def test_packets(spark):
    import struct

    from aerograph.sources import protobuf as B

    f32 = lambda n, v: B.encode_varint(n << 3 | 5) + struct.pack("<f", v)
    gps = lambda alt: B.encode([(4, B.encode([(1, B.encode([(2, 0.5), (3, 0.25)]))])), (5, alt)])
    packet = lambda alt: B.encode([(3, B.encode([(1, B.encode([(1, 7)])), (3, gps(alt)), (4, B.encode([(3, B.encode([(1, 1799), (3, 20)]))]))]))])
    no_fix = B.encode([(3, B.encode([(1, B.encode([(1, 1)]))]))])
    chunks = [packet(f32(1, 55.0)), no_fix, packet(f32(1, -3.0)), packet(f32(1, 60_000.0)), packet(B.encode([(2, 45_000)]))]
    raw, sizes = b"".join(chunks), [len(c) for c in chunks]
    rows = [("a", "DJI dvtm_WM265E", raw, sizes, [0.0, 0.1, 0.2, 0.3, 0.4]), ("b", "dvtm_other", raw, sizes, [0.0] * 5), ("c", None, raw[:-1], sizes, [0.0] * 5), ("d", "x", None, None, None), ("e", "x", b"", [], [])]
    got = B.packet_stream(spark.createDataFrame(rows, "video string, handler string, raw binary, sizes array<int>, pts_s array<double>")).collect()
    alt = lambda v: [(r.frame_idx, r.alt_m) for r in sorted(got, key=lambda r: r.frame_idx) if r.video == v]
    assert alt("a") == [(0, 55.0), (2, 80.0), (3, 60_000.0), (4, 80.0)]  # a known layout is trusted
    assert alt("b") == [(0, 55.0), (2, 80.0), (3, 60.0), (4, 80.0)]  # looked for once
    assert alt("c") == [(0, 55.0), (2, 80.0), (3, 60.0)] and not alt("d") and not alt("e")
    first = next(r for r in got if r.video == "a")
    assert round(first.lat, 6) == 28.647890 and first.timestamp_ms == 0 and first.gimbal_pitch == -90.0 and first.gimbal_yaw == 1.0
    assert B.probe_altitude(chunks[4]) == 45.0 and B.probe_altitude(b"") is None


def test_policies():
    from aerograph.functions import models

    class Busy(Exception):
        status = 429

    waits, left = [], [Busy(), Busy(), Busy()]

    def call(x):
        if left:
            raise left.pop()
        return x

    assert models.with_retries(call, 5, sleep=waits.append) == 5 and waits == [2.0, 4.0, 8.0]
    left[:] = [Busy()] * 4
    with pytest.raises(Busy):
        models.with_retries(call, 5, sleep=waits.append)
    left[:] = [ValueError("no")]
    with pytest.raises(ValueError):
        models.with_retries(call, 5, sleep=waits.append)
    import time

    assert models.within(0.3, [lambda: 1, lambda: time.sleep(1.0), lambda: 1 / 0]) == [1, None, None]
    assert models.Vocabulary()("Field", "Crate") == {"expected": ["Field", "aerial view of Field", "normal"], "anomaly": ["Crate", "aerial view of Crate", "anomaly", "unusual"]}


def test_movers_are_judged_in_batches(spark):
    from aerograph.functions import models

    sizes = []
    models.register("counting", lambda: lambda shot, rows: [{"index": i, "confirmed": len(rows) <= 25, "confidence": 0.5, "reason": f"{shot} {len(rows)}"} for i in range(len(rows))])
    movers = spark.createDataFrame([(1, i, 100 + i) for i in range(60)] + [(2, 99, 5)], "s long, track_id long, last_frame long")
    snaps = spark.createDataFrame([(1, 90), (1, 180)], "s long, snap long")
    got = models.judge_movers(movers, snaps, "s", "counting").collect()
    assert len(got) == 60 and all(r.confirmed for r in got)  # a series without snapshots is not judged
    assert {(r.snap, r.vlm_reason) for r in got} == {(90, "1/90 25"), (90, "1/90 11"), (180, "1/180 24")} and not sizes


def test_store_and_catalogue(spark, tmp_path):
    from aerograph.operators import catalog as C
    from aerograph.operators import store as ST

    segments = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), ("b", 0, 3.0)], "frame_path string, seg_idx int, area double")
    assert ST.insert_segments(f"{tmp_path}/s", segments.limit(0)) == 0 and ST.insert_segments(f"{tmp_path}/s", segments) == 3
    known = spark.read.parquet(f"{tmp_path}/s")
    assert [r.area for r in ST.segments_of(known, "a").collect()] == [1.0, 2.0]
    asked = spark.createDataFrame([("a",), ("c",), ("a",)], "frame_path string")
    assert {r.frame_path: [s.area for s in r.segments] for r in ST.segments_for(asked, known).collect()} == {"a": [1.0, 2.0], "c": []}
    ST.save_json(spark.createDataFrame([("x", None, "u"), (None, 2, "u")], "track_id string, n long, img_urls string"), f"{tmp_path}/j")
    assert [tuple(r) for r in ST.load_json(spark, f"{tmp_path}/j", "track_id string, n long", ("track_id",)).collect()] == [("x", None)]

    c = C.Catalog(spark, f"file://{tmp_path}/cat")
    for i, name in enumerate(("one", "two")):
        c.create(name, name)
        c.activate(name, i + 1)
    assert c.last_active() == "two" and c.get("one").count() == 1 and [r.id for r in c.every().collect()] == ["two", "one"]
    c.update_counts("one", "ready", 5, 7)
    row = c.get("one").first()
    assert (row.status, row.frame_count, row.tile_count, row.segment_count) == ("ready", 5, 7, 0)
    c.update_counts("one", "analysed")
    assert c.get("one").first().frame_count == 5
    wiped = f"file://{tmp_path}/s"
    with pytest.raises(ValueError):
        c.delete("two", "other", wiped)
    assert c.delete("two", "two", wiped) == "one" and c.last_active() == "one" and not (tmp_path / "s").exists()
    assert c.archive("one") is None and c.last_active() is None
    keyed = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v long")
    assert sorted(map(str, C.replace_rows(keyed, keyed.withColumn("v", F.lit(9)), ["k"]).collect())) == ["Row(k='a', v=9)", "Row(k=None, v=9)"]
    assert C.replace_rows(keyed, keyed, ["k"], ignore=True).count() == 2


def test_percentiles_and_numbers(spark):
    import random

    import numpy as np

    from aerograph.operators import detections as D
    from aerograph.operators import records as X

    rng = random.Random(3)
    rows = [(k, v) for k, n in (("a", 900), ("b", 1), ("c", 7), (None, 40)) for v in [rng.choice([rng.gauss(0, 1), 0.5, 1e6 if k == "a" else 2.0]) for _ in range(n)]] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r for r in D.percentiles(df, ["k"], "v", shares, bins=16).collect()}
    for k in ("a", "b", "c", None):
        own = [v for g, v in rows if g == k and v is not None]
        assert got[k].n == len(own) and np.allclose(got[k].p, np.quantile(own, shares), rtol=1e-12, atol=1e-12)
    assert "d" not in got and D.describe(df, ["k"], "v").filter("k = 'd'").first().n == 0
    few = spark.createDataFrame([(float(i), 0.0) for i in range(5)] + [(500.0, 0.0)], "lat double, lon double")
    assert D.coverage_outliers(few, limit=2.6).count() == 5 and D.coverage_outliers(few, limit=0.1).count() == 6 and D.coverage_outliers(few.limit(5), limit=0.1).count() == 5
    many = spark.range(2000).selectExpr("id % 3 AS g", "(id * 7919) % 1009 AS o", "id")
    ranks = {r.id: r.pos for r in X.numbered(many, "g", ["o", "id"]).collect()}
    for g in range(3):
        own = sorted(((i * 7919) % 1009, i) for i in range(2000) if i % 3 == g)
        assert [ranks[i] for _, i in own] == list(range(1, len(own) + 1))


def test_placed_targets_are_seen(spark):
    from aerograph.operators import geometry as O
    from aerograph.plans.pipeline_queries import camera_frames

    targets = spark.createDataFrame([(i, 40.0 * i, 2.0, 0, 30) for i in range(6)] + [(9, 0.0, 900.0, 0, 3)], "id long, bearing double, speed_ms double, first_frame long, last_frame long")
    cam = camera_frames(spark)
    placed = O.place_targets(targets, cam, 2.0)
    rows = {r.id: r for r in placed.collect()}
    assert all(rows[i].placed for i in range(6)) and not rows[9].placed and (rows[9].lat, rows[9].lon) == (32.0, 34.8)
    assert sorted(map(str, placed.collect())) == sorted(map(str, O.place_targets(targets, cam, 2.0).collect()))
    seen = O.ground_truth(placed, cam, 2.0).filter("visible").groupBy("id").count()
    assert all(r["count"] >= 5 for r in seen.filter("id < 6").collect()) and seen.filter("id < 6").count() == 6


def exif_bytes(order="<", ref=b"S", alt=(8250, 100)):
    """A made-up image head: a main directory with a GPS one."""
    import struct

    p = lambda kind, *v: struct.pack(order + kind, *v)
    gps_at, values = 8 + 2 + 12 * 3 + 4, 8 + 2 + 12 * 3 + 4 + 2 + 12 * 5 + 4
    main = p("H", 3) + p("HHII", 0x0100, 4, 1, 4032) + p("HHII", 0x0101, 4, 1, 3024) + p("HHII", 0x8825, 4, 1, gps_at) + p("I", 0)
    gps = p("H", 5) + p("HHI", 1, 2, 2) + ref + b"\0\0\0" + p("HHII", 2, 5, 3, values) + p("HHI", 3, 2, 2) + b"E\0\0\0" + p("HHII", 4, 5, 3, values + 24) + p("HHII", 6, 5, 1, values + 48) + p("I", 0)
    rationals = p("6I", 32, 1, 30, 1, 36, 1) + p("6I", 34, 1, 45, 1, 0, 1) + p("2I", *alt)
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + (b"II" if order == "<" else b"MM") + p("HI", 42, 8) + main + gps + rationals


def test_exif(spark):
    from aerograph.sources import exif

    for order in "<>":
        got = exif.read_exif(exif_bytes(order))
        assert (round(got["lat"], 6), round(got["lon"], 6), got["alt_m"], got["img_w_px"], got["img_h_px"]) == (-32.51, 34.75, 82.5, 4032, 3024)
    assert exif.read_exif(None)["lat"] is None and exif.read_exif(b"Exif\0\0XX")["lat"] is None and exif.read_exif(exif_bytes()[:40])["lat"] is None
    xmp = b'<x drone:RelativeAltitude="+40.5" drone:GimbalYawDegree="12.5"/>'
    rows = [("a", exif_bytes()), ("b", exif_bytes(ref=b"N") + xmp), ("c", None), ("d", exif_bytes() + xmp.replace(b"+40.5", b"+0.0"))]
    got = {r.full_path: r for r in exif.parse_image(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [(k, r.z, r.gimbal_yaw, r.img_w_px) for k, r in sorted(got.items())] == [("a", 82.5, 0.0, 4032), ("b", 40.5, 12.5, 4032), ("c", 0.0, 0.0, 4000), ("d", 82.5, 12.5, 4032)]
    assert round(got["b"].lat, 6) == 32.51 and got["c"].lat is None


def test_masks_and_views(spark):
    import numpy as np

    from aerograph.functions import models

    def masker():
        def mask(tile, point):
            if tile == "none":
                raise RuntimeError
            out = np.zeros((20, 20))
            out[point[1] - 2 : point[1] + 2, point[0] - 2 : point[0] + 6] = 1
            return out

        return mask

    models.register("masker", masker)
    df = spark.createDataFrame([("t", 5.0, 5.0, 9.0, 9.0), ("none", 0.0, 0.0, 4.0, 4.0)], "tile string, x1 double, y1 double, x2 double, y2 double")
    assert [(r.mask_inside, r.mask_area) for r in models.box_masks(df, "tile", "masker").orderBy(F.desc("tile")).collect()] == [(16, 32), (None, None)]

    def viewer():
        tries = {}

        def view(tile, query):
            tries[tile] = tries.get(tile, 0) + 1
            if tile == "d/late" and tries[tile] < 3 or tile == "d/never":
                raise ValueError("no JSON")
            return {"report": f"a {query}", "targets": [{"label": query, "bbox": [1, 2, 3, 4], "confidence": 0.5}] if tile != "d/void" else []}

        return view

    models.register("viewer", viewer)
    tiles = spark.createDataFrame([("d/a",), ("d/late",), ("d/never",), ("d/void",)], "tile string").coalesce(1)
    views = models.ground_views(tiles, "tile", "car", "viewer", sleep=lambda s: None)
    one = models.merged_views(views, "tile").first()
    assert one.report == "a: a car | late: a car" and len(one.targets) == 2 and one.summary == "2 tiles with detections, 1 tiles confirmed empty"
    assert models.merged_views(views.limit(0), "tile").first().report == "No detections found. 0 tiles with detections, 0 tiles confirmed empty"
