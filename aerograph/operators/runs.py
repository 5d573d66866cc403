"""Statistics of runs: one appended row for each, with the funnel, percentiles and a histogram, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("detected", "suppressed", "sized", "confirmed")
BINS = 25


def summary(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """run, query, threshold (where given), and a struct for each stage: n, lo, p25, p50, p75, p90, mean, hi, and counts of BINS bins on [0, 1].

    ``stages``: run, stage, conf, one row per detection that reached the stage. Stages that nothing reached have n = 0.
    """
    keys = [c for c in (run, "query", "threshold") if c in stages.columns]
    bin_of = F.least(F.lit(BINS - 1), F.floor(F.col("conf") * BINS).cast("int"))
    out = None
    for s in STAGES:
        own, c = F.col("stage") == s, F.when(F.col("stage") == s, F.col("conf"))
        q = F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
        r = lambda x: F.round(x, 4)
        cells = F.array(*(F.count_if(own & F.col("conf").between(0, 1) & (bin_of == b)) for b in range(BINS)))
        made = F.struct(F.count_if(own).alias("n"), r(F.min(c)).alias("lo"), *(r(q[i]).alias(p) for i, p in enumerate(("p25", "p50", "p75", "p90"))), r(F.avg(c)).alias("mean"), r(F.max(c)).alias("hi"), cells.alias("bins"))
        out = [*(out or []), made.alias(s)]
    rows = stages.groupBy(*keys).agg(*out)
    lost = lambda a, b: F.when(F.col(f"{a}.n") == 0, 0.0).otherwise(F.round((F.col(f"{a}.n") - F.col(f"{b}.n")) / F.col(f"{a}.n"), 4))
    return rows.withColumns({f"lost_{b}": lost(a, b) for a, b in zip(STAGES, STAGES[1:])})


def append(path: str, rows: DataFrame, run: str = "run_id") -> None:
    """Add the rows of runs that the table at ``path`` does not have, so that a repeated call adds nothing."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(run), run, "left_anti")
    rows.write.mode("append").parquet(path)


def report(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """run, text: a Markdown report of each row of ``summary``."""
    cell = lambda s, c: F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit("-"))
    lines = [F.concat(F.lit("# Run "), F.col(run).cast("string")), F.lit("| stage | n | lo | p50 | p90 | mean | hi |"), F.lit("| --- | --- | --- | --- | --- | --- | --- |")]
    lines += [F.concat(F.lit(f"| {s} | "), F.concat_ws(" | ", *(cell(s, c) for c in ("n", "lo", "p50", "p90", "mean", "hi"))), F.lit(" |")) for s in STAGES]
    lines += [F.concat(F.lit(f"- lost before {s}: "), F.col(f"lost_{s}").cast("string")) for s in STAGES[1:]]
    return rows.select(run, F.array_join(F.array(*lines), "\n").alias("text"))


def batch_counts(frames: DataFrame, tiles: str = "n_tiles", error: str = "error", skipped: str = "skipped", keys: tuple[str, ...] = ()) -> DataFrame:
    """tiles_ok, frames_failed, frames_skipped of an ingest (per key): a frame that failed or was skipped adds no tiles."""
    bad, left = F.col(error).isNotNull(), F.coalesce(F.col(skipped), F.lit(False))
    ok = F.sum(F.when(bad | left, 0).otherwise(F.col(tiles)))
    return frames.groupBy(*keys).agg(F.coalesce(ok, F.lit(0)).cast("long").alias("tiles_ok"), F.count_if(bad).alias("frames_failed"), F.count_if(left & ~bad).alias("frames_skipped"))


def motion_counters(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """tracks, confirmed, suppressed, by_world, by_range, visible (confirmed and not suppressed) of a motion run's tracks."""
    c = lambda x, name: F.count_if(x).alias(name)
    by = F.col("suppressed_by")
    return tracks.groupBy(*keys).agg(F.count("*").alias("tracks"), c(F.col("confirmed"), "confirmed"), c(by.isNotNull(), "suppressed"), c(by == "world_fixed", "by_world"), c(by == "range", "by_range"), c(F.col("confirmed") & by.isNull(), "visible"))
