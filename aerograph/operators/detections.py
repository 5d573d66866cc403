"""Detections: suppression, caps, merging, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, EARTH_RADIUS_M
from aerograph.functions import geo as G
from aerograph.functions import scalar as S


def valid_boxes(df: DataFrame, min_side: int = DEFAULT.min_bbox_px) -> DataFrame:
    """Boxes of positive size with both sides of ``min_side`` pixels at least."""
    return df.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side))


def parse_detector_output(df: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per usable box of a detector's JSON reply; unreadable replies, short and inverted boxes give none."""
    shape = "struct<detections: array<struct<bbox: array<double>, confidence: double, label: string>>>"
    rows = df.withColumn("__d", F.explode(F.from_json(reply, shape)["detections"])).filter(F.size("__d.bbox") == 4)
    box = {n: F.col("__d.bbox")[i].cast("int") for i, n in enumerate(("x1", "y1", "x2", "y2"))}
    rows = rows.withColumns({**box, "confidence": F.coalesce("__d.confidence", F.lit(0.0)), "label": F.col("__d.label")}).drop("__d")
    rows = rows.filter("x2 > x1 AND y2 > y1")
    return rows.withColumns({f"frame_{n}": F.col(n) + F.col("tile_x" if n[0] == "x" else "tile_y") for n in ("x1", "y1", "x2", "y2")})


def nms(df: DataFrame, frame: str = "parent_path", key: str = "det_id", conf: str = "conf", overlap: float = DEFAULT.nms_overlap) -> DataFrame:
    """Greedy class-agnostic suppression per frame, as a fold over the frame's boxes by (-confidence, key).

    Boxes of a frame are bounded by its tiles' caps, so a frame fits a row.
    """
    box = F.struct((-F.col(conf)).alias("c"), F.col(key).alias("k"), "x1", "y1", "x2", "y2")
    gathered = df.groupBy(frame).agg(F.array_sort(F.collect_list(box)).alias("b"))
    empty = F.slice("b", 1, 0)
    kept = F.aggregate("b", empty, lambda acc, d: F.when(F.exists(acc, lambda a: S.box_overlap(a, d) > overlap), acc).otherwise(F.concat(acc, F.array(d))))
    return gathered.select(frame, F.explode(kept).alias("d")).select(frame, F.col("d.k").alias(key), (-F.col("d.c")).alias(conf), "d.x1", "d.y1", "d.x2", "d.y2")


def tile_cap(df: DataFrame, keys: list[str], cap: int = DEFAULT.tile_cap, conf: str = "conf", key: str = "det_id") -> DataFrame:
    """The ``cap`` most confident rows of every tile."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(conf), key))).filter(F.col("rn") <= cap).drop("rn")


def merge_angles(df: DataFrame, group: str, threshold_m: float = DEFAULT.merge_m, most: int = DEFAULT.max_angles) -> DataFrame:
    """Geo clusters: by falling confidence, a row joins the first seed within the threshold or seeds one.

    Returns group, instance_id (from 1 in seed order), det_id, conf, is_multiangle of the best row per
    frame, at most ``most`` frames an instance.
    """
    item = F.struct((-F.col("conf")).alias("c"), F.col("det_id").alias("k"), "lat", "lon", "frame_seq")
    near = lambda a, d: G.haversine_m(a["lat"], a["lon"], d["lat"], d["lon"]) <= threshold_m
    gathered = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("b"))
    seeds = F.aggregate("b", F.slice("b", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda a: near(a, d)), acc).otherwise(F.concat(acc, F.array(d))))
    rows = gathered.withColumn("seeds", seeds).select(group, "seeds", F.explode("b").alias("d"))
    first = F.array_position(F.transform("seeds", lambda a: near(a, F.col("d"))), F.lit(True))
    rows = rows.select(group, first.alias("instance_id"), F.col("d.k").alias("det_id"), (-F.col("d.c")).alias("conf"), "d.frame_seq")
    best = rows.withColumn("rn", F.row_number().over(W.partitionBy(group, "instance_id", "frame_seq").orderBy(F.desc("conf"), "det_id"))).filter("rn = 1")
    w = W.partitionBy(group, "instance_id")
    best = best.withColumn("rn", F.row_number().over(w.orderBy(F.desc("conf"), "det_id"))).filter(F.col("rn") <= most)
    return best.withColumn("is_multiangle", F.count("*").over(w) > 1).drop("rn")


#: Rounds in which seeds are found side by side; rows that wait for longer chains are decided by one pass.
ROUNDS = 12


def first_in_reach(left: DataFrame) -> DataFrame:
    """b: the seeds among open rows, by one forward pass over their pairs (a, a_conf, b: a row before a in reach); memory holds the ids that are none."""
    import pandas as pd

    def run(parts):
        dropped, now, seed = set(), None, True
        for pdf in parts:
            found = []
            for a, b in zip(pdf.a, pdf.b):
                if a != now:
                    if now is not None:
                        found.append(now) if seed else dropped.add(now)
                    now, seed = a, True
                seed = seed and b in dropped
            yield pd.DataFrame({"b": pd.Series(found, dtype="int64")})
        if now is not None and seed:
            yield pd.DataFrame({"b": pd.Series([now], dtype="int64")})

    kind = left.schema["b"].dataType
    ends = left.select("b").join(left.select(F.col("a").alias("b")).hint("merge"), "b", "left_anti").distinct()  # nothing is before these
    rows = left.select(F.col("a").cast("long"), "a_conf", F.col("b").cast("long")).repartition(1).sortWithinPartitions(F.desc("a_conf"), "a")
    return ends.unionByName(rows.select("a", "b").mapInPandas(run, "b long").select(F.col("b").cast(kind)))


def merge_detections(df: DataFrame, threshold_m: float = DEFAULT.merge_m, most: int = DEFAULT.max_angles) -> DataFrame:
    """Geo clusters over the whole table, by the rule of ``merge_angles``; instance_id is the seed's det_id (det_id is unique).

    Pairs within the threshold come from an equi-join on cells of that size in space. Seeds are found in rounds: an undecided
    row with no undecided row before it in reach is one, and decides the rows in its reach; so no group is one task. What is
    undecided after ROUNDS rounds (long chains of falling confidence) is decided by one forward pass. No table is sent to the
    driver: the joins are merge joins, since a table's size on disk says little of its rows. Rows without a place are
    instances of their own.
    """
    from aerograph.scratch import cut

    size = threshold_m * (1 + 1e-9) + 1e-6
    lat, lon = F.radians("lat"), F.radians("lon")
    x = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    rows = cut(df.select("det_id", "conf", "lat", "lon", "frame_seq", *(F.floor(v * EARTH_RADIUS_M / size).alias(k) for k, v in x.items())), "detections")
    step = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    b = rows.select(F.col("det_id").alias("b"), F.col("conf").alias("b_conf"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), *(F.col(k).alias(f"b_{k}") for k in x))
    for k in x:
        b = b.withColumn("__s", step).withColumn(f"b_{k}", F.col(f"b_{k}") + F.col("__s")).drop("__s")
    met = rows.join(b.hint("merge"), [F.col(k) == F.col(f"b_{k}") for k in x])
    first = (F.col("b_conf") > F.col("conf")) | (F.col("b_conf") == F.col("conf")) & (F.col("b") < F.col("det_id"))
    pairs = cut(met.filter(first & (G.haversine_m("b_lat", "b_lon", "lat", "lon") <= threshold_m)).select(F.col("det_id").alias("a"), F.col("conf").alias("a_conf"), "b", "b_conf"), "near-pairs")
    merged = lambda x, y, on, how="inner": x.join(y.hint("merge"), on, how)
    left, seeds = pairs.select("a", "a_conf", "b"), merged(rows.select(F.col("det_id").alias("b")), pairs.select(F.col("a").alias("b")), "b", "left_anti")
    new = seeds
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        out = cut(merged(left, new, "b", "left_semi").select("a").distinct(), "decided")
        rest = merged(left, out, "a", "left_anti")  # pairs of rows still open, with all rows before them
        rest = cut(merged(rest, out.withColumnRenamed("a", "b"), "b", "left_anti"), "open-pairs")
        open_rows = merged(left.select("a").distinct(), out, "a", "left_anti")
        new = cut(merged(open_rows, rest.select("a"), "a", "left_anti").withColumnRenamed("a", "b"), "seeds")
        left, seeds = rest, seeds.unionByName(new)
    else:
        if not left.isEmpty():
            seeds = seeds.unionByName(cut(first_in_reach(left), "seeds")).distinct()
    seed = merged(pairs, seeds, "b", "left_semi").groupBy(F.col("a").alias("det_id")).agg(F.max_by("b", F.struct("b_conf", -F.col("b"))).alias("seed"))
    made = merged(rows, seed, "det_id", "left").select(F.coalesce("seed", "det_id").alias("instance_id"), "det_id", "conf", "frame_seq")
    best = made.withColumn("rn", F.row_number().over(W.partitionBy("instance_id", "frame_seq").orderBy(F.desc("conf"), "det_id"))).filter("rn = 1")
    w = W.partitionBy("instance_id")
    best = best.withColumn("rn", F.row_number().over(w.orderBy(F.desc("conf"), "det_id"))).filter(F.col("rn") <= most)
    return best.withColumn("is_multiangle", F.count("*").over(w) > 1).drop("rn")


def isolation_gate(df: DataFrame, radius: float, frame: str = "frame_seq", key: str = "det_id", x: str = "cx", y: str = "cy") -> DataFrame:
    """Rows without another row of their frame within ``radius``; cells of that size make it an equi-join."""
    if radius <= 0:
        return df
    cell = lambda c: F.floor(F.col(c) / radius)
    a = df.withColumns({"__i": cell(x), "__j": cell(y)})
    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    b = df.select(F.col(frame).alias("__f"), F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.explode(F.array(*near)).alias("__n"))
    b = b.withColumns({"__bi": F.floor(F.col("__x") / radius) + F.col("__n.i"), "__bj": F.floor(F.col("__y") / radius) + F.col("__n.j")})
    on = (a[frame] == b["__f"]) & (a["__i"] == b["__bi"]) & (a["__j"] == b["__bj"]) & (a[key] != b["__k"]) & (F.hypot(a[x] - b["__x"], a[y] - b["__y"]) <= radius)
    return a.join(b, on, "left_anti").drop("__i", "__j")


def blob_gate(df: DataFrame, low, high, aspect: float = DEFAULT.aspect_limit) -> DataFrame:
    ratio = F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1))
    return df.filter((F.col("area") >= low) & (F.col("area") <= high) & (ratio <= aspect))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """keys, n, lo, hi, mean and p (array, linearly interpolated) of each group's values that are not null; exact.

    Counts by bin tell in which bins the wanted ranks lie; only the values of those bins are counted one by one. So a group's state is
    a few numbers per task, and its rows are never gathered.
    """
    v = F.col("__v")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL AND NOT isnan(__v)")
    spans = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.avg("__v").alias("mean"))
    same = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in keys] or F.lit(True)
    named = lambda d, *more: d.select(*(F.col(k).alias(f"__{k}") for k in keys), *more)
    edges = named(spans, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    cell = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))).otherwise(0).cast("int")
    binned = rows.join(edges, same(rows, edges)).select(*keys, "__v", cell.alias("__bin"))
    w = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0))).withColumn("__n", F.sum("__c").over(W.partitionBy(*keys)))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("__n") - 1) * s), F.ceil((F.col("__n") - 1) * s)) for s in shares))))
    inside = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))
    wanted = counts.withColumn("__ranks", F.filter(ranks, inside)).filter(F.size("__ranks") > 0)
    wanted = named(wanted, F.col("__bin").alias("__b"), "__before", "__ranks")
    few = binned.join(wanted, [*([] if not keys else same(binned, wanted)), F.col("__bin") == F.col("__b")]).groupBy(*keys, "__bin", "__v", "__before", "__ranks").agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    few = few.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__c").over(upto), F.lit(0)))
    found = few.select(*keys, "__v", F.explode(F.filter("__ranks", inside)).alias("__r"))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at"))
    at = named(at, "__at")
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    value_at = lambda s: F.col("__at")[F.floor(place(s))] + (F.col("__at")[F.ceil(place(s))] - F.col("__at")[F.floor(place(s))]) * (place(s) - F.floor(place(s)))
    return spans.join(at, same(spans, at)).select(*keys, "n", "lo", "hi", "mean", F.array(*map(value_at, shares)).alias("p"))


def describe(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """count, min, p25, p50, mean, p75, p90, max per group, percentiles by linear interpolation. Groups without values have a count of 0."""
    out = df.select(*keys).distinct()
    found = percentiles(df, keys, value, (0.25, 0.5, 0.75, 0.9))
    found = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", "lo", "hi", "mean", "p")
    out = out.join(found, [out[k].eqNullSafe(found[f"__{k}"]) for k in keys], "left")
    r = lambda c: F.round(c, digits)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), r("lo").alias("lo"), *(r(F.col("p")[i]).alias(name) for i, name in enumerate(("p25", "p50", "p75", "p90"))), r("mean").alias("mean"), r("hi").alias("hi"))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Counts of equal bins on [0, 1]; the right edge belongs to the last bin."""
    return df.filter(F.col(value).between(0, 1)).groupBy(F.least(F.lit(bins), F.floor(F.col(value) * bins).cast("int") + 1).alias("bin")).agg(F.count("*").alias("n"))


def best_row(df: DataFrame, keys: list[str], conf: str, order: str, columns: list[str]) -> DataFrame:
    """The most confident row of each group (the first of equals)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(conf), -F.col(order))).alias("b")).select(*keys, "b.*")


def frame_times(dets: DataFrame, frames: DataFrame, key: str = "frame_name") -> DataFrame:
    """Left join of timestamps; a missing one is 0."""
    times = frames.select(key, F.col("ts_ms").alias("__ts")).dropDuplicates([key])
    return dets.join(times, key, "left").withColumn("ts_ms", F.coalesce("__ts", F.lit(0))).drop("__ts")


def timeline(dets: DataFrame, frames: DataFrame, source: str = "source", parent: str = "parent_path", label: str = "label") -> DataFrame:
    """``dets`` with timestamp_ms, found by the source's name or else by the parent's file name (null if by neither), and the label cut to 60 characters."""
    times = frames.groupBy("frame_name").agg(F.min("ts_ms").alias("__ts"))
    by = lambda d, name, out: d.join(times.select(F.col("frame_name").alias("__name"), F.col("__ts").alias(out)), name == F.col("__name"), "left").drop("__name")
    both = by(by(dets, F.col(source), "__own"), S.basename(parent), "__parent")
    return both.withColumns({"timestamp_ms": F.coalesce("__own", "__parent"), label: F.substring(F.coalesce(label, F.lit("")), 1, 60)}).drop("__own", "__parent")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Left join with the first matching row of ``right``; missing numbers are 0."""
    one = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__m"))
    return left.join(one, key, "left").withColumns({c: F.coalesce(F.col(f"__m.{c}"), F.lit(0.0)) for c in columns}).drop("__m")


def hull_frame(df: DataFrame, group: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Convex hulls (group, seq, x, y), counter-clockwise from the smallest point, collinear points left out.

    Each partition's hull is found first and only its corners are shuffled.
    """
    import pandas as pd

    def hull(points):
        pts = sorted(set(points))
        if len(pts) < 3:
            return pts
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                    del out[-1]
                out.append(p)
            return out[:-1]

        return chain(pts) + chain(pts[::-1])

    def local(batches):
        for pdf in batches:
            for g, part in pdf.groupby(group, dropna=False):
                corners = hull(list(zip(part[x], part[y])))
                yield pd.DataFrame({group: [g] * len(corners), x: [c[0] for c in corners], y: [c[1] for c in corners]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(list(zip(pdf[x], pdf[y])))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(corners), "seq": range(len(corners)), x: [c[0] for c in corners], y: [c[1] for c in corners]})

    kind = df.schema[group].dataType.simpleString()
    part = df.select(group, x, y).dropna(subset=[x, y]).mapInPandas(local, f"{group} {kind}, {x} double, {y} double")
    return part.groupBy(group).applyInPandas(whole, f"{group} {kind}, seq int, {x} double, {y} double")


def coverage_outliers(df: DataFrame, lat: str = "lat", lon: str = "lon", limit: float = 0.15) -> DataFrame:
    """Points within ``limit`` degrees of the median on both axes; all points where there are under 6 or under 3 would stay."""
    middle = lambda c, name: percentiles(df, [], c, (0.5,)).select(F.col("n").alias(f"__n_{name}"), F.col("p")[0].alias(f"__{name}"))
    mid = middle(lat, "a").join(middle(lon, "b"))  # one row
    judged = df.join(F.broadcast(mid), how="left").withColumn("__near", (F.abs(F.col(lat) - F.col("__a")) < limit) & (F.abs(F.col(lon) - F.col("__b")) < limit))
    stay = judged.agg(F.count_if("__near").alias("__stay"))  # one row
    all_in = (F.col("__n_a") < 6) | (F.col("__stay") < 3)
    return judged.join(F.broadcast(stay)).filter(F.coalesce("__near", F.lit(False)) | all_in).select(*df.columns)


def recentre(df: DataFrame, group: list[str]) -> DataFrame:
    span = lambda c: (F.max(c) - F.min(c)) * 1.3
    out = df.groupBy(*group).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), span("lat").alias("__a"), span("lon").alias("__b"))
    return out.withColumn("zoom", S.zoom("__a", "__b")).drop("__a", "__b")


def without(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key ``keyed`` does not have; null keys are equal."""
    other = keyed.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = [rows[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return rows.join(other, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` does not have; null keys are equal."""
    return without(old, new, keys).unionByName(new)


def not_yet(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``known``, so that a repeated ingest adds nothing."""
    return rows.join(known.select(key).distinct(), key, "left_anti")
