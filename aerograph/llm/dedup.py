"""MinHash near-dedup with bottom-k sketches from one hash function.

Every text becomes the set of its shingle hashes (64 bits); equal sets form a class.
A class keeps its ``K`` smallest values as its sketch. Inverted lists of retained
values give the overlaps: two sets with a Jaccard similarity of ``percent`` or more
share at least ``c`` retained values (surely when both sketches hold the whole set,
else but for a chance below 1e-8, see ``needed``), so they meet in one of the lists of the
``size - c + 1`` rarest retained values of either. Only those lists are read, and
values that one class alone retains link nothing, so a passage that a third of all
texts hold is read only by texts made of little else.

1. In every list, each member is compared with the list's hub, its most central class: sizes, overlap and the
   union sketch's estimate drop pairs that are far below the threshold. The distinct pairs left over are few more than the classes.
2. Lists whose members these pairs do not connect are compared in whole, sketch with sketch, in blocks of ``BLOCK`` classes: the members outside
   a list's largest part meet all members. Only a spanning forest of the pairs that pass leaves a block.
3. The pairs connect classes to groups; every link lies inside one. The pairs are verified by the exact Jaccard similarity of the full sets. Where they
   leave a group in several parts, the classes outside its largest part meet the whole group, in blocks of ``BLOCK`` classes and about ``BYTES`` bytes, and a spanning
   forest of the confirmed links completes every component.

A class or list with any number of copies is dealt out in blocks, a task holds two blocks of one run at a time,
and no block sends on more pairs than it has members.

Null and empty texts have an empty set, are linked with nothing, and are components
of their own. Rows with equal doc_id or text are kept, each with its class's component.
A component is named by its smallest non-null doc_id (null where all are null). Extra
columns are ignored by ``near_duplicates`` and carried by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, blobs, cut, over_batches, shingle_hashes, table

K = 64
BLOCK = 64
BYTES = 4_000_000
PIECE = 1024  # values of a row in which sets are sent to blocks
LINKS = "a long, b long"


@cache
def surely_shared(percent: int) -> int:
    """The most retained values that two similar sets of over K values share but for a chance below 1e-8: P(Binomial(K, percent %) < c)."""
    p, below = percent / 100, 0.0
    for c in range(K + 1):
        below += math.comb(K, c) * p**c * (1 - p) ** (K - c)
        if below >= 1e-8:
            return c
    return K


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """How many retained values a sketch of a set of ``size`` shares at least with that of any similar set."""
    size = np.asarray(size, np.int64)
    whole = -(-percent * size // 100) - np.maximum(0, 100 * size // percent - K)
    return np.where(size <= K, np.maximum(1, whole), surely_shared(percent))


def text_sets(texts: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text, A-Z lower-cased."""
    words = [t.lower().split() for t in texts]
    flat = hashes([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        out.append(np.unique(shingle_hashes(flat[at : at + len(ws)], width) >> np.uint64(1)))
        at += len(ws)
    return out


def set_id(values: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def parts(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, so that a batch of long texts takes bounded memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def shingled(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """rid (a hash of doc_id and text), doc_id, node (the set's hash, null for the empty set), n (set size), sketch (the K smallest values) of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        texts, hashes = blobs(batch.column(2)), WordHashes()
        nodes, sizes, kept = [], [], []
        for a, b in parts(texts):
            for s in text_sets(texts[a:b], width, hashes):
                nodes.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                kept.append(s[:K].view(np.int64))
        return {"rid": batch.column(0), "doc_id": batch.column(1), "node": nodes, "n": sizes, "sketch": kept}

    rows = df.select(F.xxhash64(df[key], df[text]).alias("rid"), df[key].alias("doc_id"), df[text].alias("text"))
    return over_batches(rows, "rid long, doc_id long, node long, n long, sketch array<long>", step)


def class_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """node, piece, vals: the sorted set of each class of ``wanted`` (node, rid, doc_id: a row of the class), in pieces of PIECE values."""

    def step(batch: pa.RecordBatch) -> dict:
        texts, hashes, nodes = blobs(batch.column(1)), WordHashes(), batch.column(0).to_pylist()
        out: dict[str, list] = {"node": [], "piece": [], "vals": []}
        for a, b in parts(texts):
            for node, s in zip(nodes[a:b], text_sets(texts[a:b], width, hashes)):
                for at in range(0, len(s), PIECE):
                    out["node"].append(node)
                    out["piece"].append(at // PIECE)
                    out["vals"].append(s[at : at + PIECE].view(np.int64))
        return out

    some = docs.select(F.xxhash64(docs[key], docs[text]).alias("rid"), docs[key].alias("__id"), docs[text].alias("text"))
    some = some.join(wanted, "rid").filter("__id <=> doc_id").select("node", "text").dropDuplicates(["node"])
    return over_batches(some, "node long, piece int, vals array<long>", step)


def components(edges: DataFrame, label: str, cut: Callable) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Every round maps each node to its smallest neighbour or itself and contracts the links
    by that map, which at least halves the nodes that still have links. Rounds are written to the
    shared folder. Minima combine map-side, and a hub's links are split by adaptive execution.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = cut(edges.select(*ordered("a", "b")).filter("a < b").distinct(), f"{label}-links")
    names = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), f"{label}-step")
        if names is None:
            names = step.withColumnRenamed("to", "root")
        else:
            names = cut(names.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{label}-roots")
        for end in ("a", "b"):
            links = links.join(step.withColumnsRenamed({"node": end, "to": "__to"}), end).withColumn(end, F.col("__to")).drop("__to")
        links = cut(links.select(*ordered("a", "b")).filter("a < b").distinct(), f"{label}-links")
        if links.isEmpty():
            return names


def extended(names: DataFrame, edges: DataFrame, label: str, cut: Callable) -> DataFrame:
    """``names`` (node, root) after more ``edges``; a node that ``names`` lacks is its own root so far."""
    for end in ("a", "b"):
        edges = edges.join(names.withColumnsRenamed({"node": end, "root": "__to"}), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    edges = cut(edges.filter("a <> b").distinct(), f"{label}-more")
    if edges.isEmpty():
        return names
    more = components(edges, label, cut)
    old = names.join(more.select(F.col("node").alias("root"), F.col("root").alias("__to")), "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return cut(old.unionByName(more.join(names, "node", "left_anti")), f"{label}-all")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[j] = i
        return True


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Of the union's K smallest values (by the sketches), how many both hold; and how many there are."""
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    distinct = np.cumsum(np.append(True, ~twice))
    within = distinct <= min(K, max(len(a), len(b)))
    return int(twice[within[1:]].sum()), int(distinct[within][-1])


def alike(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes n and m with sketches a and b may be similar: their overlap, and the union sketch's estimate."""
    sure = surely_shared(percent)
    whole = lambda x: F.greatest(F.lit(1), F.ceil(x * percent / 100) - F.greatest(F.lit(0), F.floor(x * 100 / percent) - K))
    need = F.least(*(F.when(x <= K, whole(x)).otherwise(sure) for x in (n, m)))
    common = F.array_intersect(a, b)
    lowest = F.slice(F.sort_array(F.array_union(a, b)), 1, K)  # of the union
    return (F.size(common) >= need) & ((F.size(lowest) < K) | (F.greatest(n, m) <= K) | (F.size(F.array_intersect(lowest, common)) >= sure))


def links_within(nodes: list[int], sizes: np.ndarray, sets: list[np.ndarray], known: list[int], left: range, right: range, percent: int, exact: bool) -> list[tuple[int, int]]:
    """Pairs (of a spanning forest) between rows of ``left`` and of ``right`` that are links or, if not ``exact``, that sketches let pass.

    ``known``: rows with equal values are connected already. Overlaps come from the inverted lists of
    the rows' retained values, summed by one product of 0/1 matrices; sizes and the union
    sketch's estimate filter; the exact similarity decides.
    """
    forest, first = Forest(len(sets)), {}
    for i, k in enumerate(known):
        forest.join(first.setdefault(k, i), i)
    out = []
    sketch = [s[:K] for s in sets]
    values, column = np.unique(np.concatenate(sketch), return_inverse=True)
    held = np.zeros((len(sets), len(values)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(s) for s in sketch]), column] = 1
    shared = held[left.start : left.stop] @ held[right.start : right.stop].T
    need, a, b = needed(sizes, percent), sizes[left.start : left.stop, None], sizes[None, right.start : right.stop]
    like = (shared >= np.minimum(need[left.start : left.stop, None], need[None, right.start : right.stop])) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    if left == right:
        like = np.triu(like, 1)
    rows, cols = np.nonzero(like)
    for at in np.argsort(-shared[rows, cols], kind="stable"):
        i, j = int(rows[at]) + left.start, int(cols[at]) + right.start
        if forest.find(i) == forest.find(j):
            continue
        if max(sizes[i], sizes[j]) > K:
            both, seen = union_estimate(sketch[i], sketch[j])
            if seen >= K and both < surely_shared(percent):
                continue
        if exact:
            common = np.concatenate([sets[i], sets[j]])
            common.sort()
            inter = int((common[1:] == common[:-1]).sum())
            if 100 * inter < percent * (len(common) - inter):
                continue
        forest.join(i, j)
        out.append((nodes[i], nodes[j]))
    return out


def by_run(rows: DataFrame, keys: list[str], percent: int, exact: bool) -> DataFrame:
    """Deal ``rows`` (keys, right, node, known, n, piece, vals) out by ``keys`` and link each run of equal keys: its left rows with its right ones, or with themselves where it has none."""
    dealt = rows.select(*keys, "right", "node", "known", "n", "piece", "vals").repartition(*keys).sortWithinPartitions(*keys, "right", "node", "piece")
    width = len(keys)

    def linked(held: list[tuple]) -> list[tuple[int, int]]:
        sets: list[list[np.ndarray]] = []
        about: list[tuple] = []
        for right, node, known, n, _, vals in held:
            if about and about[-1][:2] == (right, node):
                sets[-1].append(vals)
            else:
                about.append((right, node, known, n))
                sets.append([vals])
        whole = [(s[0] if len(s) == 1 else np.concatenate(s)).view(np.uint64) for s in sets]
        end = sum(right == 0 for right, *_ in about)
        left, right = range(end), range(end, len(about))
        return links_within([x[1] for x in about], np.array([x[3] for x in about]), whole, [x[2] for x in about], left, right if len(right) else left, percent, exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
                if row[:width] != now:
                    if held:
                        out += linked(held)
                    held, now = [], row[:width]
                held.append((*row[width:], values[ends[i] : ends[i + 1]]))
        if held:
            out += linked(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, LINKS)


def parted(members: DataFrame, unit: str) -> DataFrame:
    """unit, main (its largest part), blocks (of all members) and rest (blocks of those outside main) of the units whose members (unit, node, known, held: values to ship) are in several parts."""
    parts = members.groupBy(unit, "known").agg(F.count("*").alias("c"), F.sum("held").alias("v"))
    units = parts.groupBy(unit).agg(F.max_by(F.struct("known", "c", "v"), F.struct("c", "known")).alias("m"), F.sum("c").alias("c"), F.sum("v").alias("v"))
    blocks = lambda c, v: F.greatest(F.ceil(c / BLOCK), F.ceil(v * 8 / BYTES), F.lit(1)).cast("int")
    units = units.filter("m.c < c")
    return units.select(unit, F.col("m.known").alias("main"), blocks(F.col("c"), F.col("v")).alias("blocks"), blocks(F.col("c") - F.col("m.c"), F.col("v") - F.col("m.v")).alias("rest"))


def facing(members: DataFrame) -> DataFrame:
    """The runs in which the members of a unit outside its main part meet all members; what one block holds meets itself.

    Adds i, j (blocks of those outside and of all) and right to members (node, known, main, blocks, rest).
    """
    alone, upto = F.col("blocks") == 1, lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    away = members.filter(~alone & (F.col("known") != F.col("main"))).withColumn("right", F.lit(0))
    away = away.withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest")).cast("int")).withColumn("j", F.explode(upto("blocks")))
    whole = members.withColumn("right", F.when(alone, 0).otherwise(1)).withColumn("j", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = whole.withColumn("i", F.explode(F.when(alone, F.array(F.lit(0))).otherwise(upto("rest"))))
    return away.unionByName(whole)


def candidate_groups(classes: DataFrame, percent: int, cut: Callable) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b that sketches let pass; node, root: the groups they connect) of classes (node, n, sketch); every link lies inside a group."""
    entries = classes.select("node", "n", F.explode("sketch").alias("value"))
    lists = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    # Values that one class alone retains are the rarest: their number is all that is needed of them.
    held = entries.join(lists, "value")
    per = held.groupBy("node").agg(F.first("n").alias("n"), F.sum("df").alias("weight"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    n, k = F.col("n"), F.least(F.col("n"), F.lit(K))
    whole = F.ceil(n * percent / 100) - F.greatest(F.lit(0), F.floor(n * 100 / percent) - K)
    need = F.when(n <= K, F.greatest(F.lit(1), whole)).otherwise(surely_shared(percent))
    prefix = (k - need + 1 - (k - F.size("shared"))).cast("int")  # after the values that the class alone retains
    kept = cut(per.withColumn("prefix", prefix).filter("prefix > 0").select("node", "n", "weight", F.explode(F.slice("shared", F.lit(1), F.col("prefix"))["value"]).alias("value")), "prefix")
    # Merge joins by value, which split a value that very many classes retain. The most central member is the hub of most of its lists, so that a group has few pairs more than members.
    hubs = kept.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    hubs = cut(hubs, "hubs")
    pairs = kept.join(hubs.hint("merge"), "value").filter("node <> hub.node AND 100 * least(n, hub.n) >= {0} * greatest(n, hub.n)".format(percent))
    pairs = pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    near = cut(pairs.filter(alike(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"), percent)).select("a", "b"), "near")
    groups = components(near, "groups", cut)

    # Lists of three members or more that these pairs leave in parts. Lists with the same members are compared once.
    open_lists = kept.join(hubs.filter("members > 2").select("value").hint("merge"), "value").join(groups, "node", "left").select("value", "node", "n", F.coalesce("root", "node").alias("known"), F.least("n", F.lit(K)).alias("held"))
    open_lists = cut(open_lists, "open-lists")  # so that the sums per list start map-side, and a hot list's join can be split
    several = open_lists.groupBy("value").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("h"), F.min("node").alias("m")).filter("x <> y")
    several = several.groupBy("c", "h", "m").agg(F.min("value").alias("value")).select("value")
    members = cut(open_lists.join(several.hint("merge"), "value"), "open")
    runs = members.join(cut(parted(members, "value"), "open-units").hint("merge"), "value").join(classes.select("node", "sketch"), "node").withColumns({"piece": F.lit(0), "vals": F.col("sketch")}).drop("sketch")
    more = cut(by_run(facing(runs), ["value", "i", "j"], percent, False).distinct(), "near-more")
    return near.unionByName(more), extended(groups, more, "groups", cut)


def class_links(docs: DataFrame, key: str, text: str, width: int, percent: int, cut: Callable) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id, node, n; roots: node, root of every class that has a link)."""
    rows = cut(shingled(docs, key, text, width), "rows")
    classes = rows.filter("node IS NOT NULL").groupBy("node")
    classes = cut(classes.agg(F.min(F.struct("doc_id", "rid")).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    near, groups = candidate_groups(classes.select("node", "n", "sketch"), percent, cut)
    wanted = classes.join(groups.select("node"), "node", "left_semi").select("node", "id.rid", "id.doc_id")
    sets = cut(class_sets(docs, key, text, width, wanted), "sets")
    sizes = classes.select("node", "n")

    whole = sets.groupBy("node").agg(F.flatten(F.array_sort(F.collect_list(F.struct("piece", "vals")))["vals"]).alias("s"))
    pairs = near
    for end in ("a", "b"):
        pairs = pairs.join(whole.withColumnsRenamed({"node": end, "s": f"s_{end}"}), end)
    similar = (100 + percent) * F.size(F.array_intersect("s_a", "s_b")) >= percent * (F.size("s_a") + F.size("s_b"))
    links = cut(pairs.filter(similar).select("a", "b"), "links")
    roots = components(links, "parts", cut)

    members = groups.select("node", F.col("root").alias("grp")).join(roots, "node", "left").join(sizes, "node")
    members = cut(members.select("grp", "node", "n", F.coalesce("root", "node").alias("known")), "members")
    runs = members.join(cut(parted(members.withColumn("held", F.col("n")), "grp"), "open-units").hint("merge"), "grp").join(sets, "node")
    more = cut(by_run(facing(runs), ["grp", "i", "j"], percent, True), "links-more")
    return rows.select("rid", "doc_id", "node", "n"), extended(roots, more, "parts", cut)


def grouped(docs: DataFrame, key: str, text: str, width: int, percent: int, cut: Callable) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id, node, n; of every class: node, component_id, root, the component's smallest class)."""
    rows, roots = class_links(docs, key, text, width, percent, cut)
    firsts = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, cut(firsts.join(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id", "root"), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node (the class), part (the component's smallest class) of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows, named = grouped(docs, key, text, width, percent, scratch)
        # Both sides of the join are exchanges, so a class with many copies is split.
        out = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"), "node", F.col("root").alias("part")), "near-duplicates")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the row with the smallest doc_id stays, once.

    Rows without words are no duplicates of anything and all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, named = grouped(docs, key, text, width, percent, scratch)
        firsts = rows.filter("node IS NOT NULL").join(named, "node").filter("doc_id <=> component_id")
        one = firsts.groupBy("root").agg(F.min(F.struct("node", "rid", "doc_id")).alias("x")).select("x.rid", "x.doc_id", F.lit(True).alias("once"))
        empty = rows.filter("node IS NULL").select("rid", "doc_id", F.lit(False).alias("once")).distinct()
        wanted = cut(one.unionByName(empty).withColumnsRenamed({"rid": "__rid", "doc_id": "__id", "once": "__once"}), "wanted")
    found = docs.withColumn("__own", F.xxhash64(docs[key], docs[text]))
    found = found.join(wanted, F.expr(f"__own = __rid AND `{key}` <=> __id"))
    once = found.filter("__once").dropDuplicates(["__own", key])
    return once.unionByName(found.filter("NOT __once")).select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = a
"""
