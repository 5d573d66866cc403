"""Mixing sources to target weights by fitting a word budget with a subset sum.

1. Sizes are counted exactly, per source and size.
2. Sources by code point, null last, weigh 5, 2, 1, repeating, and share all words;
   a target stops at three times its source's size, and the excess is dealt out by
   weight until none is above (the fixed point is found from running sums over the sources).
3. A source takes all its documents as often as its whole size fits its target. For the budget left, every size gives
   the same share of its documents, rounded down; what then remains is filled size by
   size, largest first, down to ``SPARE`` words, which a bounded-knapsack
   dynamic programme fits as closely as the documents left allow.
4. Of each source and size as many documents as planned are taken, those with the smallest
   seeded hashes. Where a size holds many documents they are counted by hash bucket first, and only
   the bucket in which the planned number falls is ranked, so no group is sorted in one task.

Null and empty texts have size 0 and take 0 words. Repeated rows are documents of
their own; among rows with equal hash, doc_id and text the choice makes no difference.
Runs with equal input and seed agree. Extra columns are ignored by ``mix`` and carried by
``mixed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table

WEIGHTS = (5, 2, 1)
MOST = 3  # a document or source is taken so many times at most
SPARE = 4096  # words that the dynamic programme fits
SEED = 20_240
PER_BUCKET = 16
MAX_BITS = 12


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0): a first one, and those that start after white space. Linear in the text."""
    blank = r"[\x20\x09-\x0D]"
    first = F.substring(text, 1, 1).rlike(blank.replace("[", "[^")).cast("int")
    return F.coalesce(first + F.regexp_count(text, F.lit(blank + blank.replace("[", "[^"))), F.lit(0)).cast("long")


def ranked(sizes: DataFrame, cut: Callable) -> DataFrame:
    """``sizes`` (one row per source) with rank, from 1: sources by code point, null last. Range partitions are numbered apart and then offset."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    dealt = cut(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    before, starts = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row per partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = sizes.sparkSession.createDataFrame(starts, "part int, before long")
    numbered = dealt.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return numbered.join(starts, "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, cut: Callable) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source.

    Shares are ``level`` times the weight; sources above their cap get that, and the level rises until none is: a
    few aggregates, each over all sources.
    """
    k = F.pmod("rank", F.lit(3))
    rows = ranked(sizes, cut).withColumn("w", F.when(k == 1, WEIGHTS[0]).when(k == 2, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("long")).withColumn("cap", MOST * F.col("source_size"))
    rows = cut(rows, "weights")
    some = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    left, weight = some["t"], some["w"]  # the level is left / weight
    while weight:
        capped = rows.filter(F.col("cap").cast("decimal(38,0)") * F.lit(weight) < F.col("w").cast("decimal(38,0)") * F.lit(left)) if left else rows.limit(0)
        held = capped.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
        now = (some["t"] - held["cap"], some["w"] - held["w"])
        if now == (left, weight):
            break
        left, weight = now
    level = left / weight if weight else float("inf")
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take, at most ``counts``, for the largest sum that is not above ``budget``.

    A bitset over sums; counts are split into powers of two.
    """
    parts, reach, mask = [], [1], (1 << (budget + 1)) - 1
    for i, (s, c) in enumerate(zip(sizes, counts)):
        c, p = min(c, budget // s if s else 0), 1
        while c > 0:
            p = min(p, c)
            parts.append((i, p))
            reach.append(reach[-1] | (reach[-1] << (s * p)) & mask)
            c, p = c - p, 2 * p
            if reach[-1] >> budget & 1:
                break
        if reach[-1] >> budget & 1:
            break
    at, taken = reach[-1].bit_length() - 1, [0] * len(sizes)
    for k in range(len(parts) - 1, -1, -1):
        if not reach[k] >> at & 1:
            i, p = parts[k]
            taken[i] += p
            at -= sizes[i] * p
    return taken


def plan_source(sizes: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """(how often all are taken, how many documents of each size are taken once more)."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if not total:
        return 0, [0] * len(sizes)
    budget = min(MOST * total, round(target))
    base = budget // total
    left = budget - base * total
    extra = [c * left // total for c in counts]
    left -= sum(s * e for s, e in zip(sizes, extra))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if sizes[i] and left > SPARE:
            more = min(counts[i] - extra[i], (left - SPARE) // sizes[i])
            extra[i] += more
            left -= more * sizes[i]
    free = [i for i in order if 0 < sizes[i] <= left and counts[i] > extra[i]]
    if left > 2 * SPARE:  # what is free has over left - SPARE words, so one document fits
        free, left = free[:1], sizes[free[0]] if free else 0
    for i, n in zip(free, knapsack([sizes[i] for i in free], [counts[i] - extra[i] for i in free], left)):
        extra[i] += n
    return base, extra


def plan(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """source, size, docs, base, extra from (source, size, docs), a histogram with one row per source and size."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        base, extra = plan_source(pdf["size"].tolist(), pdf["docs"].tolist(), float(pdf["target"].iloc[0]))
        return pdf[["source", "size", "docs"]].assign(base=base, extra=extra)

    joined = counts.join(goals, counts["source"].eqNullSafe(goals["source"])).select(counts["source"], "size", "docs", "target")
    return joined.groupBy("source").applyInPandas(fit, "source string, size long, docs long, base long, extra long")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns and of which are null."""
    return F.xxhash64(*df.columns, *(df[c].isNull() for c in df.columns))


def numbered(documents: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """row, doc_id, source, size, h (the seeded hash) and same (the text's hash) of ``documents``; rows with equal row are repeated ones."""
    key, source, text = documents[key], documents[source], documents[text]
    return documents.select(
        row_hash(documents).alias("row"), key.alias("doc_id"), source.alias("source"), word_count(text).alias("size"),
        F.xxhash64(key, F.lit(SEED)).alias("h"), F.xxhash64(text, F.lit(SEED + 1)).alias("same"),
    )


def copies(rows: DataFrame, cut: Callable) -> DataFrame:
    """``rows`` with source_size, target and copies (how often the mix takes each)."""
    counts = cut(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "sizes")
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), cut), "targets")
    wanted = cut(plan(counts, goals), "plan")
    some = wanted.select("source", "size", "docs", "base", "extra")
    # Buckets of about PER_BUCKET documents, by the hash's highest bits.
    bits = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / PER_BUCKET)))).cast("int")
    placed = rows.join(some.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), F.expr("source <=> s AND size = z")).drop("s", "z")
    placed = placed.withColumn("bucket", F.expr(f"shiftrightunsigned(h, {64 - MAX_BITS})"))
    placed = placed.withColumn("bucket", F.floor(F.col("bucket") / F.pow(F.lit(2.0), MAX_BITS - bits)).cast("long"))
    part = placed.filter("extra > 0 AND extra < docs")
    filled = part.groupBy("source", "size", "bucket").agg(F.first("extra").alias("extra"), F.count("*").alias("n"))
    upto = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    cutoff = filled.filter("before < extra AND before + n >= extra").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("last"), (F.col("extra") - F.col("before")).alias("need"))
    cutoff = cut(cutoff, "cutoff")
    judged = placed.join(cutoff, F.expr("source <=> s AND size = z"), "left").drop("s", "z")
    at = W.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", "same", "row")
    edge = judged.filter("bucket = last").withColumn("more", (F.row_number().over(at) <= F.col("need")).cast("int"))
    rest = judged.filter("last IS NULL OR bucket <> last").withColumn("more", F.when(F.col("last").isNull(), (F.col("extra") > 0)).otherwise(F.col("bucket") < F.col("last")).cast("int"))
    made = edge.unionByName(rest).withColumn("copies", F.col("base") + F.col("more")).drop("docs", "base", "extra", "bucket", "last", "need", "more", "h", "same")
    g = goals.withColumnRenamed("source", "s")
    return made.join(g, F.expr("source <=> s")).drop("s")


def mix(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch(numbered(documents, key, source, text), "numbered")
        return cut(copies(rows, scratch).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")), "mix")


def mixed(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix with all columns of ``documents`` and ``__copies``, how often each is taken (1 to 3, or more for a repeated row, which stands once here).

    Only ids, hashes and sizes ride through the choice; whole rows meet their number of copies at the end.
    """
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch(numbered(documents, key, source, text), "numbered")
        taken = copies(rows, scratch).groupBy("row").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__times"))
        taken = cut(taken.filter("__copies > 0").withColumnRenamed("row", "__row"), "taken")
    found = documents.withColumn("__row", row_hash(documents)).join(taken, "__row")
    once, several = found.filter("__times = 1"), found.filter("__times > 1").dropDuplicates(["__row"])
    return once.unionByName(several).select(*documents.columns, "__copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
