"""Which frames of a clip are kept, and with which telemetry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerograph.config import DEFAULT
from aerograph.operators.sequences import by_key, interpolate

SAME_SCENE = 1.5  # mean absolute difference of grey values below which a frame shows what the last kept one shows


class Sampler:
    """A clip's clock: the first frame at or after the next due time is kept, unless it looks like the last one that was kept."""

    def __init__(self):
        self.due, self.look, self.n = 0.0, None, 0

    def add(self, frame: int, ms: float, look, wait_ms: float):
        if ms < self.due:
            return []
        look = None if look is None else np.asarray(look, float)
        if self.look is not None and look is not None and look.shape == self.look.shape and np.abs(look - self.look).mean() < SAME_SCENE:
            return []  # the due time stays, so the next frame is looked at
        self.look, self.due, self.n = look, ms + wait_ms, self.n + 1
        return [(frame, ms, self.n - 1)]


def sample(frames: DataFrame, key: str = "clip", wait_s: str | float = DEFAULT.sample_interval_s) -> DataFrame:
    """key, frame_idx, ms, sample (from 0) of the kept frames of ``frames`` (key, frame_idx, ms, look).

    ``look``: a frame's grey values (a thumbnail's will do) as an array; null where unknown. ``wait_s``: seconds to the next sample, a number or a column.
    """
    wait = F.lit(float(wait_s)) if isinstance(wait_s, (int, float)) else F.col(wait_s)
    rows = frames.select(key, "frame_idx", F.col("ms").cast("double").alias("ms"), F.col("look").cast("array<double>").alias("look"), (wait * 1000.0).alias("wait_ms"))
    kind = frames.schema["frame_idx"].dataType.simpleString()
    return by_key(rows, [key], ["frame_idx"], f"frame_idx {kind}, ms double, sample long", Sampler, lambda state, row: state.add(*row), lambda state: [])


def sample_with_telemetry(frames: DataFrame, telemetry: DataFrame, columns: list[str], key: str = "clip", wait_s: str | float = DEFAULT.sample_interval_s, base_ms: float = 0.0) -> DataFrame:
    """Kept frames with the telemetry at their time on the whole recording's clock (``base_ms`` after a segment's start). telemetry: key, ms, columns."""
    kept = sample(frames, key, wait_s).withColumn("ms", F.col("ms") + base_ms)
    return interpolate(telemetry.withColumn("ms", F.col("ms").cast("double")), kept, key, "ms", columns)
