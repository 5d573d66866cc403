"""Vector search, pre-filter and segment scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerograph.config import DEFAULT
from aerograph.functions import scalar as S


def vector(values) -> F.Column:
    """A query vector as a literal, so that a search is one scan without a join."""
    return F.array(*(F.lit(float(x)) for x in values))


def knn(tiles: DataFrame, query, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows nearest by L2 distance; ties by key."""
    return tiles.withColumn("dist", S.l2(column, query)).orderBy("dist", key).limit(k)


def knn_diverse(tiles: DataFrame, query, k: int, frames: int, parent: str = "parent_path", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Of the k nearest rows the first of each parent, the nearest ``frames`` of them."""
    near = knn(tiles, query, k, key, column)
    first = near.withColumn("rn", F.row_number().over(W.partitionBy(parent).orderBy("dist", key))).filter("rn = 1").drop("rn")
    return first.orderBy("dist", key).limit(frames)


def best(df: DataFrame, value: str, k: int, key: str, low: float = -1.0, high: float = 1.0, bins: int = 4096, rounds: int = 3) -> DataFrame:
    """The ``k`` rows (all, if there are fewer) with the largest ``value``, a number between ``low`` and ``high``; ties by key.

    Histograms narrow the interval in which the k-th value lies. Rows above it are taken by a filter, and only
    the interval's own rows are ranked, so no task sorts the k rows.
    """
    x, least, most = F.col(value), low, high
    need, width = k, 0.0
    for _ in range(rounds):
        width = (high - low) / bins
        if low + width == low:
            break
        at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - low) / width).cast("int")))
        counts = dict(df.filter((x >= low) & (x <= high)).groupBy(at).count().collect())  # ``bins`` rows at most
        b = bins - 1
        while b > 0 and counts.get(b, 0) < need:
            need, b = need - counts.get(b, 0), b - 1
        low, high = low + b * width, min(high, low + (b + 1) * width)
        if counts.get(b, 0) <= bins:
            break
    while True:  # bins and bounds are rounded apart, so the interval is checked, and widened if need be
        above = x >= high if high < most else F.lit(False)
        n = df.agg(F.count_if(above).alias("above"), F.count_if(x >= low).alias("all")).first()
        if n["above"] > k:
            high += width
        elif n["all"] < k and low > least:
            low -= width
        else:
            break
    edge = df.filter((x >= low) & ~above).orderBy(F.desc(value), key).limit(max(0, k - n["above"]))
    return df.filter(above).unionByName(edge) if n["above"] else edge


def prefilter(tiles: DataFrame, query, hard: bool = False, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The fraction of tiles most similar to the query: 60 % of up to 20 (2 at least), else 30 % (20 at least), in no order."""
    scored = tiles.withColumn("sim", S.cosine(column, query, 1e-9))
    n = tiles.count()
    if hard or n < 4:
        return scored
    return best(scored, "sim", max(2, int(0.6 * n)) if n <= 20 else max(20, int(0.3 * n)), key)


#: A query's word list has so many terms at most.
MAX_TERMS = 1000


def score_segments(segments: DataFrame, vocabulary: DataFrame, key: str = "vec_id", column: str = "embedding", margin: float = DEFAULT.margin) -> DataFrame:
    """Segments (with ``best_anomaly``, ``best_expected``, ``score``) whose relative margin is over ``margin``.

    ``vocabulary`` (side, vec) is a query's word list, of MAX_TERMS terms at most; its vectors are literals, and
    an empty side gives an empty result.
    """
    terms = vocabulary.select("side", "vec").limit(MAX_TERMS + 1).collect()
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a vocabulary of more than {MAX_TERMS} terms")
    sides = {side: [list(r["vec"]) for r in terms if r["side"] == side] for side in ("anomaly", "expected")}
    if not sides["anomaly"] or not sides["expected"]:
        return segments.withColumns({c: F.lit(0.0) for c in ("best_anomaly", "best_expected", "score")}).filter(F.lit(False))
    top = lambda side: F.greatest(*x) if len(x := [S.cosine(column, vector(v)) for v in sides[side]]) > 1 else x[0]
    scored = segments.withColumn("best_anomaly", top("anomaly")).withColumn("best_expected", top("expected"))
    return scored.withColumn("score", S.margin("best_anomaly", "best_expected")).filter(F.col("score") > margin)


def top_segments(segments: DataFrame, vocabulary: DataFrame, n: int = DEFAULT.top_segments, key: str = "vec_id", column: str = "embedding", margin: float = DEFAULT.margin) -> DataFrame:
    """The ``n`` segments with the largest margin, the largest first; ties by key."""
    return score_segments(segments, vocabulary, key, column, margin).orderBy(F.desc("score"), key).limit(n)
