"""Vector, box, number and text column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerograph.config import DEFAULT, Camera
from aerograph.functions.geo import col

#: Phrases that mark an anomaly query.
ANOMALY_PHRASES = (
    "unusual", "anomaly", "anomalies", "out of place", "doesn't belong", "foreign",
    "discoloured", "discolored", "shouldn't be there", "not supposed to", "unexpected",
)
#: Colours that query results cycle through.
COLOURS = ("#4ade80", "#60a5fa", "#f59e0b", "#f472b6", "#a78bfa", "#34d399", "#fb923c", "#e879f9")
#: Spans of degrees and the map zoom that shows them.
ZOOMS = ((0.002, 18), (0.005, 17), (0.01, 16), (0.02, 15), (0.05, 14), (0.1, 13), (0.2, 12), (0.5, 11), (1.0, 10), (2.0, 9), (5.0, 8))
#: Altitudes and the seconds between samples up to them.
ALTITUDE_INTERVALS = ((30.0, 1.0), (60.0, 2.0), (120.0, 3.0))


def _fold(x: Column, zero: float = 0.0) -> Column:
    return F.aggregate(x, F.lit(zero).cast("double"), lambda a, b: a + b)


def _double(v) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return _fold(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_fold(F.transform(_double(a), lambda x: x * x)))


def l2(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b, eps: float = 0.0) -> Column:
    """Cosine similarity; 0 where a norm is 0 (with ``eps``: added to the norms' product)."""
    n = norm(a) * norm(b)
    return dot(a, b) / (n + eps) if eps else F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def margin(anomaly, expected) -> Column:
    """Relative margin; the plain difference where ``expected`` is near 0."""
    a, e = col(anomaly), col(expected)
    return F.when(e > 0.01, (a - e) / e).otherwise(a - e)


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The larger of intersection over union and intersection over the smaller box (denominators of 1 at least)."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    return F.greatest(inter / F.greatest(F.lit(1), area(a) + area(b) - inter), inter / F.greatest(F.lit(1), F.least(area(a), area(b))))


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(x)))


def ladder(x: Column, steps, otherwise) -> Column:
    """The value of the first step that ``x`` does not exceed."""
    (top, value), *rest = steps
    return reduce(lambda w, t: w.when(x <= t[0], t[1]), rest, F.when(x <= top, value)).otherwise(otherwise)


def altitude_interval(alt) -> Column:
    """Seconds between samples where the speed is unknown."""
    return ladder(col(alt), ALTITUDE_INTERVALS, 5.0)


def adaptive_interval(alt, speed, overlap: float = DEFAULT.sample_overlap, camera: Camera = DEFAULT.camera) -> Column:
    """Seconds between samples that keep the wanted overlap; by altitude alone where it or the speed is not positive."""
    width = col(alt) * camera.sensor_w_mm / camera.focal_mm
    by_speed = clamp((1 - overlap) * width / col(speed), DEFAULT.min_interval_s, DEFAULT.max_interval_s)
    return F.when((col(alt) > 0) & (col(speed) > 0), by_speed).otherwise(altitude_interval(alt))


def cell(x, scale) -> Column:
    """Grid cell number, cut toward zero."""
    return (col(x) * col(scale)).cast("int")


def confidence_colour(c) -> Column:
    c = col(c)
    return F.when(c >= 0.85, "green").when(c >= 0.60, "orange").otherwise("red")


def zoom(lat_span, lon_span) -> Column:
    """Map zoom for spans of degrees."""
    span = F.greatest(col(lat_span), col(lon_span))
    return F.when(span <= 0, 17).otherwise(ladder(span, ZOOMS, 7))


def rescale_altitude(x) -> Column:
    """Altitude in metres: between 1 and 10000, else a thousandth, hundredth or tenth that is; else NULL."""
    ok = lambda v: F.when((v > 1) & (v < 10_000), v)
    x = col(x)
    return F.coalesce(ok(x), ok(x / 1000), ok(x / 100), ok(x / 10))


def shape_scale(value, alt, floor: int) -> Column:
    """An area prior (px at 100 m) at another altitude; unchanged where that is not positive."""
    scaled = (col(value) * F.pow(F.lit(100.0) / col(alt), F.lit(2.0))).cast("int")
    return F.when(col(alt) > 0, F.greatest(F.lit(floor), scaled)).otherwise(col(value).cast("int"))


def motion_confidence(spread, hits, misses, threshold: float = DEFAULT.wf_threshold_m) -> Column:
    """0.65 spread (0 at the threshold, 1 at three times it) + 0.25 hits (1 at 60) + 0.10 steadiness."""
    s = clamp((col(spread) - threshold) / (2 * threshold), 0.0, 1.0)
    return 0.65 * s + 0.25 * F.least(F.lit(1.0), col(hits) / 60) + 0.10 * (1 - col(misses) / F.greatest(F.lit(1), col(hits) + col(misses)))


def dynamic_persist(speed, base: int = 16, free: float = 15.0, step: float = 5.0, most: int = 10) -> Column:
    return F.lit(base) + F.least(F.lit(most), (F.greatest(F.lit(0.0), col(speed) - free) / step).cast("int"))


# text


def timecode_ms(s) -> Column:
    p = r"(\d+):(\d+):(\d+)[,.](\d+)"
    g = lambda i: F.regexp_extract(col(s), p, i).try_cast("long")
    return g(1) * 3_600_000 + g(2) * 60_000 + g(3) * 1000 + g(4)


def ms_timecode(ms) -> Column:
    m = col(ms).cast("long")
    div = lambda a, b: F.floor(a / b)
    return F.format_string("%02d:%02d:%02d,%03d", div(m, 3_600_000), div(m, 60_000) % 60, div(m, 1000) % 60, m % 1000)


def minutes_seconds(seconds) -> Column:
    s = col(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def strip_tags(s) -> Column:
    return F.regexp_replace(col(s), r"<[^>]*>", "")


def any_phrase(text, phrases=ANOMALY_PHRASES) -> Column:
    low = F.lower(col(text))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))


def slug(text, key, size: int = 32, default: str = "mission") -> Column:
    """Folder name of a mission: its cleaned name and the first 8 characters of its key."""
    s = F.lower(F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9_\-]", "_"))
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    s = F.substring(s, 1, size)
    return F.concat(F.when(s == "", default).otherwise(s), F.lit("_"), F.substring(col(key).cast("string"), 1, 8))


def strip_fence(reply) -> Column:
    """A model's reply without a Markdown fence or leading quote marks."""
    s = F.regexp_replace(F.trim(col(reply)), r"^(?:>\s*)+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def basename(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def stable_id(parent, tx, ty, box) -> Column:
    """First 8 hex digits of the SHA-1 of an anchor detection's place."""
    boxed = F.concat(F.lit("["), F.array_join(F.transform(col(box), lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.substring(F.sha1(F.concat_ws("|", col(parent), F.concat_ws(",", col(tx).cast("string"), col(ty).cast("string")), boxed).cast("binary")), 1, 8)


def relative_date(day, today) -> Column:
    gap = F.datediff(col(today), col(day))
    return F.when(gap == 0, "today").when(gap == 1, "yesterday").otherwise(F.date_format(col(day), "MMM dd"))


def colour_of(index) -> Column:
    return F.element_at(F.array(*map(F.lit, COLOURS)), (F.pmod(col(index), F.lit(len(COLOURS))) + 1).cast("int"))


def fill_ratio(inside, x1, y1, x2, y2) -> Column:
    """Share of a box that its mask covers; a box without area counts as one pixel."""
    return col(inside) / F.greatest(F.lit(1), (col(x2) - col(x1)) * (col(y2) - col(y1)))


def rounded(x, digits: int) -> Column:
    """Rounds halves of the scaled number away from 0, as DuckDB does; ``round`` goes by the shortest decimal that stands for the number."""
    return F.round(col(x) * 10.0**digits) / 10.0**digits


def confidence_ramp(c, clamped: bool = True) -> Column:
    """struct<r, g, b> (0 to 255): the hue runs from red at 0 over yellow at a half to green at 1.

    Confidences beyond 0 and 1 count as these; if not ``clamped``, the falling side runs on below 0. An unknown confidence has no colour.
    """
    known = col(c).isNotNull()
    c = clamp(c, 0.0, 1.0) if clamped else col(c)
    return F.when(known, F.struct(
        F.round(255 * F.least(F.lit(1.0), 2 * (1 - c))).cast("int").alias("r"), F.round(255 * F.least(F.lit(1.0), 2 * c)).cast("int").alias("g"), F.lit(0).alias("b")
    ))


def label_text(label, size: int = 60) -> Column:
    """A label for display: trimmed, lower-case, cut to ``size`` characters."""
    return F.substring(F.lower(F.trim(col(label))), 1, size)


def safe_name(name) -> Column:
    """A file name without what file systems reserve."""
    return F.regexp_replace(F.trim(col(name)), r"[^A-Za-z0-9._-]+", "_")


def round_even(x, digits: int) -> Column:
    """Rounds halves to even, by the shortest decimal that stands for the number."""
    return F.bround(col(x), digits)


def short_id(*parts) -> Column:
    """Ten hexadecimal digits that depend on ``parts`` alone, so that a repeated run gives the same ids."""
    return F.substring(F.md5(F.concat_ws("|", *(col(p).cast("string") for p in parts)).cast("binary")), 1, 10)


def box_json(box) -> Column:
    return F.to_json(col(box))


def box_of(text) -> Column:
    """An array of whole numbers from JSON; null where the text is none."""
    return F.from_json(col(text), "array<int>")


def repair_box(box, width, height, slack: float = 0.05) -> Column:
    """struct<x1, y1, x2, y2> in pixels of a reply's box: on a scale of 0 to 1 or 0 to 1000 if all its numbers are, clamped to the image.

    Null where there are not four numbers, or the box is inverted or, as it stands, reaches over the image by more than ``slack``.
    """
    b, w, h = col(box), col(width), col(height)
    top = F.array_max(b)
    scale = lambda size: F.when(top <= 1, size).when((top <= 1000) & ((F.greatest(b[0], b[2]) > w * (1 + slack)) | (F.greatest(b[1], b[3]) > h * (1 + slack))), size / 1000.0).otherwise(F.lit(1.0))
    at = [F.get(b, F.lit(i)) * scale(w if i % 2 == 0 else h) for i in range(4)]
    held = [F.least(F.greatest(x, F.lit(0.0)), (w if i % 2 == 0 else h).cast("double")) for i, x in enumerate(at)]
    ok = (F.size(b) == 4) & (at[2] <= w * (1 + slack)) & (at[3] <= h * (1 + slack)) & (held[2] > held[0]) & (held[3] > held[1])
    return F.when(ok, F.struct(*(x.alias(n) for x, n in zip(held, ("x1", "y1", "x2", "y2")))))
