"""Language-model scores by context-tree weighting over bytes.

Each byte of a lower-cased (A-Z) text is eight binary decisions. At every decision the contexts
of the last 0 to ``DEPTH`` bytes form a path of a context tree whose nodes hold
Krichevsky-Trofimov (KT) estimates, and the weighted probability of a node is the mean of its
own KT probability and the product of its children's. KT probabilities depend on
counts alone, so the tree is trained in one pass: count byte runs of DEPTH + 1, derive the
shorter runs from them, and weigh from the leaves to the root. For scoring, a node's share of
the weight is its KT probability over its weighted one; a context that was not seen
gives its weight back to its parent. A text is scored with an end byte (0), from a
context of zeros; its code length per byte is ``-score / log10(2) / (n_bytes + 1)``.

All training texts are counted, and every context seen in them has its node. The tree is never in one
place: tasks weigh the contexts below the last ``LEAST`` bytes, all that share these together, and
hand on what the shorter contexts need, at most 255 nodes for each of 256 bytes; a task holds the runs of
one such pair of bytes. Each byte run of any text, trained on or not, so gets its probability in a table.
The base score needs the count of every word. The ``MAX_RUNS`` most frequent runs and ``MAX_WORDS`` most
frequent words are shipped, and all others of a text are looked up by a join, so none is
lost and both bounds change the speed alone. Words are told apart by 64-bit hashes.

Logarithms of probabilities are added as whole numbers of a small unit, and rows are
numbered by file and position, so equal texts have equal scores and reruns agree (a sum holds texts of hundreds of millions of bytes).

Null texts count as empty: one token (the end). With no training texts every count
is 0 and bytes are uniform. Rows are scored one by one (repeated rows each get their
score); extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Shared, blobs, crc32_mod, cut, over_batches, pieces, table

DEPTH = 5
LEAST = 2
MAX_RUNS = 1 << 20
MAX_WORDS = 1 << 18
END = b" "  # no word holds a space
UNIT = float(1 << 32)  # log10 probabilities of bytes are whole numbers of 1 / UNIT
HIGH, LOW = float(1 << 24), float(1 << 60)  # those of words are whole numbers of 1 / HIGH and, for the rest, of 1 / LOW
LOGS = float(1 << 16)  # so are logarithms of weighted probabilities, of 1 / LOGS
PART = 500_000  # bytes worked on at once
GROUP = 50_000  # runs weighed at once, if prefixes end
U8 = np.uint64(8)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def run_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every position, number of positions of each text): the last DEPTH bytes, most recent highest, then the byte."""
    pad = bytes(DEPTH)
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    keys = np.zeros(max(0, len(data) - DEPTH), np.uint64)
    for back in range(1, DEPTH + 1):
        keys = keys << U8 | data[DEPTH - back : len(data) - back]
    keys = keys << U8 | data[DEPTH:]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    keep = np.ones(len(keys), bool)
    for i in range(DEPTH):  # the next text's padding follows each end
        gaps = starts[1:] - DEPTH + i
        keep[gaps] = False
    return keys[keep], sizes


def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about PART bytes."""
    some, total = [], 0
    for t in texts:
        if some and total + len(t) > PART:
            yield some
            some, total = [], 0
        some.append(t)
        total += len(t)
    if some:
        yield some


class Runs:
    """Counts of byte runs; those of some parts are gathered before they are merged."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, more: np.ndarray) -> None:
        self.new.append(np.unique(more, return_counts=True))
        self.size += len(self.new[-1][0])
        if self.size > 500_000:
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.new))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.size = [], 0


def counted(documents: DataFrame) -> DataFrame:
    """kind (0: word hash, 1: byte run), key, n (in training texts), total (in all) over ``documents`` (text, train); words of training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        runs = {True: Runs(), False: Runs()}

        def out(kind: int, keys, counts, train: bool = True) -> pa.RecordBatch:
            counts = np.asarray(counts, np.int64)
            made = [np.full(len(keys), kind, np.int32), np.asarray(keys, np.int64), counts * train, counts]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["kind", "key", "n", "total"])

        for batch in pieces(batches):
            texts, sides = [t.lower() for t in blobs(batch.column(0))], batch.column(1).to_pylist()
            for side in runs:
                for some in parts([t for t, x in zip(texts, sides) if x is side]):
                    if side:
                        for t in some:
                            words.update(t.split())
                        words[END] += len(some)
                    runs[side].add(run_keys(some)[0])
                    if len(words) > 400_000:
                        yield out(0, [word_hash(w) for w in words], list(words.values()))
                        words.clear()
                    if len(runs[side].keys) > 2_000_000:
                        runs[side].merge()
                        yield out(1, runs[side].keys, runs[side].counts, side)
                        runs[side] = Runs()
        yield out(0, [word_hash(w) for w in words], list(words.values()))
        for side in runs:
            runs[side].merge()
            yield out(1, runs[side].keys, runs[side].counts, side)

    rows = documents.select("text", "train").mapInArrow(run, "kind int, key long, n long, total long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def most_frequent(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending as signed numbers, their n) of the rows (key, n, rank): those whose rank is above the least cut that keeps at most ``most``."""
    bins = F.floor(F.log2("rank") * 16).cast("int")  # counts below 2 ** 63 make at most 1008 bins
    held, least = 0, None
    for r in sorted(rows.groupBy(bins.alias("bin")).count().collect(), reverse=True):
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["bin"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = rows.filter(bins >= least).select("key", "n").toArrow()
    keys, counts = (kept.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def fixed(log10: np.ndarray) -> np.ndarray:
    return np.rint(log10 * UNIT).astype(np.int64)


def halves(log10: np.ndarray) -> np.ndarray:
    """Two rows: a high and a low part, in units of 1 / HIGH and 1 / LOW."""
    high = np.rint(log10 * HIGH)
    return np.stack([high, np.rint((log10 - high / HIGH) * LOW)]).astype(np.int64)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - np.log(np.pi) - lgamma(a + b + 1.0)


def weigh(n0: np.ndarray, n1: np.ndarray, kids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(KT probabilities of a zero and of a one, share of the weight, log of the weighted probability) of nodes; ``kids``: log product of the children's.

    Both probabilities are kept: beyond 2 ** 24 equal bits the likelier one rounds to 1, and the other is not 0.
    """
    own = log_kt(n0, n1)
    weighted = own if kids is None else np.logaddexp(own, kids) - np.log(2)
    share = np.ones(len(own)) if kids is None else np.exp(own - np.log(2) - weighted)
    p0, p1 = (((n + 0.5) / (n0 + n1 + 1)).astype(np.float32) for n in (n0, n1))
    return p0, p1, np.minimum(share, 1).astype(np.float32), weighted


class Tree:
    """Sorted node keys, KT probabilities of a zero and of a one, and share of the weight, by depth and bit."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]], least: int = 0):
        """runs[d]: (keys ascending: d context bytes and the byte, counts), used from depth ``least``."""
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in runs]
        self.edge: list[tuple] = []  # by bit: the nodes of the least depth, their counts, and the log of their weighted probability
        for bit in range(8):
            below = None
            for depth in range(len(runs) - 1, least - 1, -1):
                keys, n = runs[depth]
                byte = keys & np.uint64(255)
                node = keys >> U8 << U8 | np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
                one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
                total = lambda v: np.add.reduceat(v, first).astype(float) if len(first) else np.zeros(0)
                n1, n0, node = total(np.where(one, n, 0)), total(np.where(one, 0, n)), node[first]
                kids = None
                if below is not None:
                    child, c0, c1, logs = below
                    parent = child >> np.uint64(16) << U8 | child & np.uint64(255)
                    at = np.searchsorted(node, parent)
                    known = at < len(node)
                    known[known] = node[at[known]] == parent[known]
                    at = at[known]
                    size = len(node)
                    kids = np.bincount(at, logs[known], size).astype(float)
                    rest0, rest1 = n0 - np.bincount(at, c0[known], size), n1 - np.bincount(at, c1[known], size)
                    kids += log_kt(np.maximum(rest0, 0), np.maximum(rest1, 0))  # contexts left out of ``runs``, as one child
                p0, p1, share, weighted = weigh(n0, n1, kids)
                self.levels[depth].append((node, p0, p1, share))
                below = (node, n0, n1, weighted)
            self.edge.append(below)

    def mixed(self, keys: np.ndarray, bit: int, q: np.ndarray) -> np.ndarray:
        """Chance of a bit of the byte as it is, for byte runs; ``q``: the chance under deeper contexts, NaN where none was seen."""
        byte = keys & np.uint64(255)
        one = (byte >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        for depth in range(len(self.levels) - 1, -1, -1):
            if not self.levels[depth] or not len(self.levels[depth][bit][0]):
                continue
            node, p0, p1, share = self.levels[depth][bit]
            wanted = keys >> np.uint64(8 * (DEPTH + 1 - depth)) << U8 | np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
            at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
            hit = node[at] == wanted
            a, w = np.where(one, p1[at], p0[at]), share[at]
            q = np.where(hit, np.where(np.isnan(q), a, w * a + (1 - w) * q), q)
        return q

    def log10(self, keys: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
        """log10 P(byte | context) of byte runs; ``deeper``: a column of ``q`` for each bit."""
        out = np.zeros(len(keys))
        for bit in range(8):
            q = self.mixed(keys, bit, np.full(len(keys), np.nan) if deeper is None else deeper[:, bit].astype(float))
            out += np.log10(np.minimum(np.where(np.isnan(q), 0.5, q), 1))  # shares are rounded, so a sum can exceed 1
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of byte runs, in units."""
        return fixed(self.log10(keys))


class Top(Tree):
    """The contexts of fewer than LEAST bytes (0 and 1)."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray):
        """Nodes of one context byte (ascending, of all bits), their counts, and the log product of their children's weighted probabilities."""
        self.levels = [[], []]
        for depth in (1, 0):
            p0, p1, share, weighted = weigh(n0, n1, kids)
            number = node & np.uint64(255)
            for bit in range(8):
                own = number >> np.uint64(bit) == 1
                self.levels[depth].append((node[own], p0[own], p1[own], share[own]))
            node, at = np.unique(number, return_inverse=True)
            n0, n1, kids = (np.bincount(at, x, len(node)).astype(float) for x in (n0, n1, weighted))


def subtree(keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """SUBTREES rows of all byte runs (ascending) of some prefixes of LEAST bytes."""
    levels, seen, nothing = [], n > 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for depth in range(DEPTH + 1):
        short = keys[seen] >> np.uint64(8 * (DEPTH + 1 - depth)) << U8 | keys[seen] & np.uint64(255)
        if depth >= LEAST:
            short, at = np.unique(short, return_inverse=True)
        levels.append((short, np.bincount(at, n[seen], len(short)).astype(np.int64)) if depth >= LEAST else nothing)
    tree = Tree(levels, LEAST)
    q = np.stack([tree.mixed(keys, bit, np.full(len(keys), np.nan)) for bit in range(8)], 1).astype(np.float32)
    node, n0, n1, logs = (np.concatenate(x) for x in zip(*tree.edge))
    node, at = np.unique(node >> np.uint64(16) << U8 | node & np.uint64(255), return_inverse=True)
    sums = [np.zeros(len(node), np.int64) for _ in range(3)]
    for x, part in zip(sums, (n0, n1, np.rint(logs * LOGS))):
        np.add.at(x, at, part.astype(np.int64))
    k, m = len(keys), len(node)
    both = lambda a, b, kind: pa.array(np.concatenate([a, b]).astype(kind))
    packed = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(k + 1, dtype=np.int32) * 32), pa.py_buffer(q.tobytes())])
    made = [
        both(np.zeros(k), np.ones(m), np.int32), both(keys, node, np.int64), both(total, np.zeros(m), np.int64),
        *(both(np.zeros(k), x, np.int64) for x in sums), pa.concat_arrays([packed, pa.nulls(m, pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in SUBTREES.split(", ")])


#: kind 0: a byte run, its total, and its own bits' chances (float32) under contexts of LEAST bytes and more; kind 1: a node of LEAST - 1 bytes, parts of its sums.
SUBTREES = "kind int, key long, total long, n0 long, n1 long, logs long, q binary"


def run_scores(runs: DataFrame, cut: Callable) -> DataFrame:
    """key, total, value: log10 P(byte | context), in units, of every byte run of ``runs`` (key, n, total), by the whole tree of the counts n."""
    prefix = np.uint64(8 * (DEPTH + 1 - LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wait = [], 0, GROUP
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size >= wait:
                keys, n, total = map(np.concatenate, zip(*held))
                heads = keys.astype(np.uint64) >> prefix
                end = int(np.searchsorted(heads, heads[-1]))  # the last prefix may go on
                if end:
                    yield subtree(keys[:end].astype(np.uint64), n[:end], total[:end])
                held, size = [[keys[end:], n[end:], total[end:]]], len(keys) - end
                wait = max(GROUP, 2 * size)
        if size:
            keys, n, total = map(np.concatenate, zip(*held))
            yield subtree(keys.astype(np.uint64), n, total)

    dealt = runs.select("key", "n", "total").repartition(F.shiftright("key", int(prefix))).sortWithinPartitions("key")
    rows = cut(dealt.mapInArrow(run, SUBTREES), "subtrees")
    sums = rows.filter("kind = 1").groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "logs"))).toArrow()  # 256 * 255 rows at most
    node, n0, n1, logs = (sums.column(x).to_numpy() for x in ("key", "n0", "n1", "logs"))
    order = np.argsort(node)
    shared = Shared(runs.sparkSession, Top(node[order].astype(np.uint64), *(x[order].astype(float) for x in (n0, n1, logs / LOGS))))

    def finish(batch: pa.RecordBatch) -> dict:
        q = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8)
        return {"key": batch.column(0), "total": batch.column(1), "value": fixed(shared.value.log10(batch.column(0).to_numpy().astype(np.uint64), q))}

    return cut(over_batches(rows.filter("kind = 0").select("key", "total", "q"), "key long, total long, value long", finish), "run-scores")


class Words:
    """Numbers words: their hash, and their log10 base probability (in halves) if they are among the frequent ones."""

    def __init__(self, base: dict, limit: int = 150_000):
        self.base, self.limit, self.ids = base, limit, {}
        self.hashes, self.logs, self.rare = np.zeros(limit, np.int64), np.zeros((2, limit), np.int64), np.zeros(limit, bool)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words)
        if len(self.ids) + len(new) > len(self.hashes) or len(self.ids) > self.limit:
            self.ids.clear()
        new.difference_update(self.ids)
        at, end = len(self.ids), len(self.ids) + len(new)
        if end > len(self.hashes):
            self.hashes, self.logs, self.rare = np.zeros(end, np.int64), np.zeros((2, end), np.int64), np.zeros(end, bool)
        if new:
            new = list(new)
            keys, counts = self.base["keys"], self.base["counts"]
            hashes = np.fromiter(map(word_hash, new), np.int64, len(new))
            c = np.zeros(len(new), np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                c = np.where(keys[i] == hashes, counts[i], 0)
            self.hashes[at:end], self.rare[at:end] = hashes, c == 0
            self.logs[:, at:end] = np.where(c > 0, halves(np.log10((c + 1) / (self.base["n"] + self.base["v"] + 1))), 0)
            self.ids.update(zip(new, range(at, end)))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


class Frequent:
    """log10 P(byte | context), in units, of the byte runs that are shipped, and FAR for others."""

    FAR = 1  # logarithms are not above 0

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys.astype(np.uint64), values.astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.FAR)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.FAR)


class Scores:
    """Looks byte runs up; runs met before come from a table with one entry per slot."""

    BITS = 21

    def __init__(self, known: Frequent | Tree):
        self.known = known
        self.keys = np.full(1 << self.BITS, np.uint64((1 << 64) - 1))
        self.values = np.zeros(1 << self.BITS, np.int64)

    def each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key and score of every position, number of positions of each text)."""
        keys, sizes = run_keys(texts)
        slots = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)
        values, miss = self.values[slots], np.flatnonzero(self.keys[slots] != keys)
        if len(miss):
            new = np.unique(keys[miss])
            found = self.known(new)
            values[miss] = found[np.searchsorted(new, keys[miss])]
            slot = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)
            self.keys[slot], self.values[slot] = new, found
        return keys, values, sizes

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        _, values, sizes = self.each(texts)
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) / UNIT if len(sizes) else values


def train(documents: DataFrame, cut: Callable) -> tuple[Frequent, dict, DataFrame]:
    """(the frequent runs' scores; the frequent words' keys, counts, N and V; kind, key, x of all words (count) and runs (score)) from documents (text, train)."""
    stats = cut(counted(documents), "counts")
    words, runs = stats.filter("kind = 0").select("key", "n"), run_scores(stats.filter("kind = 1"), cut)
    frequent = Frequent(*most_frequent(runs.select("key", F.col("value").alias("n"), F.col("total").alias("rank")), MAX_RUNS))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    keys, counts = most_frequent(words.withColumn("rank", F.col("n")), MAX_WORDS)
    known = words.select(F.lit(0).alias("kind"), "key", F.col("n").alias("x")).unionByName(runs.select(F.lit(1).alias("kind"), "key", F.col("value").alias("x")))
    return frequent, {"keys": keys, "counts": counts, "n": totals["n"], "v": totals["v"]}, known


def language_model_scores(documents: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every document."""
    with Scratch(documents.sparkSession) as scratch:
        return cut(scored(documents, key, text, modulus, held, scratch), "language-model-scores")


def scored(documents: DataFrame, key: str, text: str, modulus: int, held: int, cut: Callable) -> DataFrame:
    docs = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    docs = docs.withColumn("train", crc32_mod("doc_id", modulus) != held).withColumn("row", F.monotonically_increasing_id())
    frequent, base, known = train(docs, cut)
    shared = Shared(documents.sparkSession, (frequent, base))
    schema = "row long, doc_id long, train boolean, n_bytes long, n_tokens long, known long, high long, low long, score long, rare array<long>, times array<long>, runs array<long>, run_times array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, base = shared.value
        scores, words = Scores(frequent), Words(base)
        for batch in pieces(batches):
            at = 0
            for some in parts([t.lower() for t in blobs(batch.column(1))]):
                split = [[*t.split(), END] for t in some]
                n, sizes = len(some), np.fromiter(map(len, split), np.int64, len(split))
                ids = words([w for ws in split for w in ws])
                starts = np.cumsum(sizes) - sizes
                rare = words.rare[ids]
                # The rare words of each text, with their numbers: pairs (text, word) are counted as one number.
                most = len(words.hashes)
                pairs, times = np.unique(np.repeat(np.arange(n), sizes)[rare] * most + ids[rare], return_counts=True)
                lists = lambda owner, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(x, pa.int64()))
                keys, values, lengths = scores.each(some)
                far = values == Frequent.FAR
                runs, run_times = np.unique(np.repeat(np.arange(n, dtype=np.uint64), lengths)[far] << np.uint64(48) | keys[far], return_counts=True)  # 48 bits hold a run
                made = [
                    batch.column(3).slice(at, n), batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array([len(t) for t in some], pa.int64()),
                    pa.array(sizes), pa.array(sizes - np.add.reduceat(rare.astype(np.int64), starts)), *(pa.array(np.add.reduceat(x[ids], starts)) for x in words.logs),
                    pa.array(np.add.reduceat(np.where(far, 0, values), np.cumsum(lengths) - lengths)), lists(pairs // most, words.hashes[pairs % most]), lists(pairs // most, times),
                    lists((runs >> np.uint64(48)).astype(np.int64), (runs & np.uint64((1 << 48) - 1)).astype(np.int64)), lists((runs >> np.uint64(48)).astype(np.int64), run_times),
                ]
                yield pa.RecordBatch.from_arrays(made, names=names)
                at += n

    rows = cut(docs.mapInArrow(run, schema), "scores")  # a row's number is made once, when it is written
    pairs = lambda kind, key, times: rows.filter(F.size(key) > 0).select("row", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(key).alias("key"), F.col(times).alias("times"))).alias("p")).select("row", "kind", "p.key", "p.times")
    met = pairs(0, "rare", "times").unionByName(pairs(1, "runs", "run_times")).join(known, ["kind", "key"], "left")
    n, size, word = F.coalesce("x", F.lit(0)), base["n"] + base["v"] + 1, F.col("kind") == 0
    met = met.withColumn("log", F.when(word, F.log10((n + 1) / F.lit(float(size))))).withColumn("high", F.rint(F.col("log") * HIGH))
    met = met.withColumn("low", F.rint((F.col("log") - F.col("high") / HIGH) * LOW).cast("long")).withColumn("high", F.col("high").cast("long"))
    more = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("high")).alias("more_high"), F.sum(F.col("times") * F.col("low")).alias("more_low"), F.sum(F.when(word & (n > 0), F.col("times")).otherwise(0)).alias("found"),
        F.sum(F.when(~word, F.col("times") * F.col("x"))).alias("rest"),
    )
    out = rows.drop("rare", "times", "runs", "run_times").join(more, "row", "left")
    whole = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(base["n"]).cast("long").alias("train_tokens"), (whole("high", "more_high") / HIGH + whole("low", "more_low") / LOW).alias("base_score"), (whole("score", "rest") / UNIT).alias("score"), "n_bytes",
    )


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
