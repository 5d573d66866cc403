"""Model backends: a registry of functions, and the DataFrame operators that call them.

Inference is external. A backend is a factory that makes the model once for each
worker; the stubs here are deterministic, so tests need no model. Failures of a
detector give no detections, and of a verifier unconfirmed ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY: dict[str, Callable[[], Callable]] = {}


def register(name: str, factory: Callable[[], Callable]) -> None:
    REGISTRY[name] = factory


def stub_encoder(dim: int = 64) -> Callable[[], Callable[[str], list[float]]]:
    """Unit vectors that depend on the text alone."""

    def make():
        def encode(text: str) -> list[float]:
            raw = b"".join(hashlib.sha256(f"{text}/{i}".encode()).digest() for i in range(-(-dim // 32)))[:dim]
            v = [b / 127.5 - 1 for b in raw]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            return [x / n for x in v]

        return encode

    return make


def stub_detector() -> Callable[[str, str], list[dict]]:
    def detect(tile: str, query: str) -> list[dict]:
        h = hashlib.sha256(f"{tile}/{query}".encode()).digest()
        return [{"x1": h[i], "y1": h[i + 1], "x2": h[i] + 40, "y2": h[i + 1] + 30, "confidence": h[i + 2] / 255, "label": query} for i in range(0, h[31] % 3 * 3, 3)]

    return detect


def stub_verifier() -> Callable[[str, list[dict]], list[dict]]:
    return lambda tile, found: [{"index": i, "confirmed": d["confidence"] >= 0.5, "confidence": d["confidence"]} for i, d in enumerate(found)]


register("encoder", stub_encoder())
register("detector", stub_detector)
register("verifier", stub_verifier)


def encode(df: DataFrame, text: str, out: str = "vector", backend: str = "encoder") -> DataFrame:
    """``df`` with the vectors of a text column; the model is made once for a task."""
    from pyspark.sql.functions import pandas_udf

    factory = REGISTRY[backend]

    @pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in parts:
            yield s.map(lambda x: None if x is None else model(x))

    return df.withColumn(out, run(text))


#: Seconds that a detector run may take, calls at once, and the statuses after which a call is tried again.
RUN_SECONDS, THREADS, RETRY_ON = 180.0, 8, (403, 429)
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 2.0, 30.0


def with_retries(call: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] | None = None):
    """``call(*args)``, tried again with doubled waits where it fails with a ``status`` of RETRY_ON."""
    import time

    for k in range(attempts):
        try:
            return call(*args)
        except Exception as e:
            if k == attempts - 1 or getattr(e, "status", None) not in RETRY_ON:
                raise
            (sleep or time.sleep)(min(LONGEST_WAIT, FIRST_WAIT * 2**k))


def within(seconds: float, calls: list[Callable]) -> list:
    """The results of calls made by THREADS at once, in order; None for one that failed or was not done in time."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    pool, end = ThreadPoolExecutor(THREADS), time.monotonic() + seconds
    made, out = [pool.submit(c) for c in calls], []
    for f in made:
        try:
            out.append(f.result(timeout=max(0.0, end - time.monotonic())))
        except Exception:  # noqa: BLE001  a backend's failure is an empty answer
            out.append(None)
    pool.shutdown(wait=False, cancel_futures=True)
    return out


def detect(df: DataFrame, tile: str, query: str, backend: str = "detector", seconds: float = RUN_SECONDS) -> DataFrame:
    """tile, x1, y1, x2, y2, confidence, label of every detection; a tile that fails or, after ``seconds`` of a task, is not done gives none."""
    factory, kind = REGISTRY[backend], df.schema[tile].dataType.simpleString()
    names = ["x1", "y1", "x2", "y2", "confidence", "label"]

    def run(parts):
        import time

        model, end = factory(), time.monotonic() + seconds
        for pdf in parts:
            tiles = list(pdf[tile])
            found = within(end - time.monotonic(), [lambda t=t: model(t, query) for t in tiles])
            yield pd.DataFrame([(t, *(d[n] for n in names)) for t, ds in zip(tiles, found) for d in ds or ()], columns=[tile, *names])

    return df.select(tile).mapInPandas(run, f"{tile} {kind}, x1 double, y1 double, x2 double, y2 double, confidence double, label string")


def verify(df: DataFrame, tile: str, backend: str = "verifier", batch: str | None = None, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """``df`` (one call for each tile, or each ``batch`` of it) with confirmed, vlm_confidence and vlm_reason; detections that the reply leaves out are unconfirmed."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    factory = REGISTRY[backend]
    schema = StructType([*df.schema.fields, StructField("confirmed", BooleanType()), StructField("vlm_confidence", DoubleType()), StructField("vlm_reason", StringType())])

    def run(pdf):
        rows, why = pdf.to_dict("records"), "no reply"
        try:
            reply = {r["index"]: r for r in with_retries(factory(), rows[0][tile], rows, sleep=sleep)}
        except Exception as e:  # noqa: BLE001  a backend's failure leaves all unconfirmed
            reply, why = {}, f"failed: {e}"
        own = [reply.get(i, {"reason": why}) for i in range(len(rows))]
        return pdf.assign(confirmed=[bool(r.get("confirmed", False)) for r in own], vlm_confidence=[float(r.get("confidence", 0.0)) for r in own], vlm_reason=[r.get("reason") for r in own])

    return df.groupBy(*([tile, batch] if batch else [tile])).applyInPandas(run, schema)


def judge_movers(movers: DataFrame, snapshots: DataFrame, key: str, backend: str = "verifier", size: int = 25, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Confirmed movers with their verdicts: those of a snapshot go to the verifier in batches of ``size``, on the snapshot nearest to their last frame.

    movers: key, track_id, last_frame and more. snapshots: key, snap.
    """
    from pyspark.sql import functions as F

    from aerograph.operators.pipeline import batches_of, nearest_snapshot

    near = nearest_snapshot(movers, snapshots, key).filter("snap IS NOT NULL")
    named = near.withColumn("snapshot", F.concat_ws("/", F.col(key).cast("string"), F.col("snap").cast("string")))
    return verify(batches_of(named, ["snapshot"], "track_id", size), "snapshot", backend, "batch", sleep)


AERIAL = "aerial drone nadir overhead view: "  # a fixed value: what every text query starts with


def encode_query(text: str, backend: str = "encoder") -> list[float]:
    return REGISTRY[backend]()(AERIAL + text)


class Vocabulary:
    """Expected and anomalous terms of a scene, from a backend; kept by (scene, hint) in lower case.

    Without an answer, the scene's and the hint's own words stand in.
    """

    def __init__(self, backend: Callable[[str, str], dict[str, list[str]]] | None = None):
        self.backend, self.known = backend, {}

    def __call__(self, scene: str, hint: str) -> dict[str, list[str]]:
        at = (scene.strip().lower(), hint.strip().lower())
        if at not in self.known:
            try:
                made = self.backend(scene, hint)
                made = {"expected": made.get("expected") or [scene], "anomaly": made.get("anomaly") or [hint]}
            except Exception:  # noqa: BLE001  a backend's failure, or none, leaves the fallback
                made = {"expected": [scene, f"aerial view of {scene}", "normal"], "anomaly": [hint, f"aerial view of {hint}", "anomaly", "unusual"]}
            self.known[at] = made
        return self.known[at]

    def frame(self, spark, scene: str, hint: str, encoder: str = "encoder") -> DataFrame:
        """(side, term, vec) for ``score_segments``."""
        encode = REGISTRY[encoder]()
        rows = [(side, t, encode(t)) for side, terms in self(scene, hint).items() for t in terms]
        return spark.createDataFrame(rows, "side string, term string, vec array<double>")


def segment(df: DataFrame, frame: str, backend: str, min_area: int = 400, max_share: float = 0.40) -> DataFrame:
    """frame, x1, y1, x2, y2, area of the regions of every frame; too small and too large ones are dropped.

    The backend gives dicts with a box, an area and the frame's area; a frame that fails gives none.
    """
    factory, kind = REGISTRY[backend], df.schema[frame].dataType.simpleString()

    def run(parts):
        model = factory()
        for pdf in parts:
            rows = []
            for f in pdf[frame]:
                try:
                    found = model(f)
                except Exception:  # noqa: BLE001  as above
                    found = []
                rows += [(f, *r["box"], r["area"]) for r in found if min_area <= r["area"] <= max_share * r["frame_area"]]
            yield pd.DataFrame(rows, columns=[frame, "x1", "y1", "x2", "y2", "area"])

    return df.select(frame).mapInPandas(run, f"{frame} {kind}, x1 double, y1 double, x2 double, y2 double, area double")


def box_masks(df: DataFrame, tile: str, backend: str) -> DataFrame:
    """``df`` with mask_inside and mask_area (pixels) of each box, from a backend that is asked at the box's centre; null where it gives no mask.

    The backend takes a tile and a point, and gives a 0/1 array of the tile's size.
    """
    import numpy as np
    from pyspark.sql.types import LongType, StructField, StructType

    factory = REGISTRY[backend]
    schema = StructType([*df.schema.fields, StructField("mask_inside", LongType()), StructField("mask_area", LongType())])

    def run(parts):
        model = factory()
        for pdf in parts:
            inside, area = [], []
            for t, x1, y1, x2, y2 in zip(pdf[tile], pdf.x1, pdf.y1, pdf.x2, pdf.y2):
                try:
                    mask = np.asarray(model(t, (int(x1 + x2) // 2, int(y1 + y2) // 2))) > 0
                    inside.append(int(mask[int(y1) : int(y2), int(x1) : int(x2)].sum()))
                    area.append(int(mask.sum()))
                except Exception:  # noqa: BLE001  as above
                    inside, area = inside[: len(area)] + [None], area + [None]
            yield pdf.assign(mask_inside=pd.array(inside, "Int64"), mask_area=pd.array(area, "Int64"))

    return df.mapInPandas(run, schema)


def ground_views(df: DataFrame, tile: str, query: str, backend: str, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """tile, report, targets (label, confidence, box) of each view, each asked for itself; a reply that is no answer (ValueError) is asked for again.

    report is null and targets are empty where a view holds nothing; both are null where the backend failed.
    """
    factory, kind = REGISTRY[backend], df.schema[tile].dataType.simpleString()

    def ask(model, t):
        import time

        for k in range(attempts):
            try:
                return model(t, query)
            except ValueError:
                if k < attempts - 1:
                    (sleep or time.sleep)(wait)
            except Exception:  # noqa: BLE001  as above
                break
        return None

    def run(parts):
        model = factory()
        for pdf in parts:
            made = [ask(model, t) for t in pdf[tile]]
            targets = [None if r is None else [{"label": x.get("label"), "confidence": float(x.get("confidence", 0.0)), "box": [float(v) for v in x.get("bbox", [])]} for x in r.get("targets", [])] for r in made]
            yield pd.DataFrame({tile: pdf[tile], "report": [r.get("report") if r and r.get("targets") else None for r in made], "targets": targets})

    return df.select(tile).mapInPandas(run, f"{tile} {kind}, report string, targets array<struct<label:string,confidence:double,box:array<double>>>")


def merged_views(views: DataFrame, tile: str) -> DataFrame:
    """One row: report (of the views that hold something, in order of name), targets of all, and a summary."""
    from pyspark.sql import functions as F

    hit, empty = F.size("targets") > 0, F.size("targets") == 0
    line = F.concat(F.element_at(F.split(tile, "/"), -1), F.lit(": "), F.coalesce("report", F.lit("")))
    rows = views.agg(F.count_if(hit).alias("hits"), F.count_if(empty).alias("misses"), F.array_sort(F.collect_list(F.when(hit, F.struct(line.alias("line"), F.col("targets").alias("t"))))).alias("v"))
    summary = F.concat(F.col("hits").cast("string"), F.lit(" tiles with detections, "), F.col("misses").cast("string"), F.lit(" tiles confirmed empty"))
    report = F.when(F.col("hits") > 0, F.array_join(F.col("v.line"), " | ")).otherwise(F.concat(F.lit("No detections found. "), summary))
    return rows.select(report.alias("report"), F.flatten("v.t").alias("targets"), summary.alias("summary"))
