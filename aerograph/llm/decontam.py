"""Benchmark decontamination: BM25 over an inverted index of test items, retrieved with block-max WAND.

Items are filed by length class (up to 32, 64, 128, ... words). The training passages of a
class are windows of twice its length that start every class length, so any copy of an
item lies whole in one of them; every passage of every text is a query. Scores are BM25
over the passage's distinct words, divided by the item's score against itself, so
``ALPHA`` is the share of an item's weight that a passage must hold. Only
passages with an essential word of some item (see ``LengthClass``) can reach it. They walk the postings
with block-max WAND, which skips blocks of items without such a word or whose bounds stay below
``ALPHA``, and returns all items at or above it. Retrieved pairs are verified: the share of the item's words that
runs of ``RUN`` words shared with the passage cover must be ``OVERLAP`` or more in all, and
``PART_OVERLAP`` or more in its question and in its answer (the item's last sentence).

At most ``MAX_ITEMS`` items are indexed at a time (the broadcast side); more are taken in
further passes over the texts. Null and empty texts and items match nothing; of equal
items each is reported; repeated rows of a document are reported once. Ties between
passages go to the first. Extra columns are ignored by ``leaks`` and carried by ``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, blobs, cut, over_batches, pieces, table

ALPHA, OVERLAP, PART_OVERLAP, RUN = 0.7, 0.8, 0.5, 5
K1, B = 1.2, 0.75
BLOCK = 16
SMALLEST = 32
MAX_ITEMS = 100_000
TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+")
SENTENCE = re.compile(rb"[.!?\n]+\s*")


def tokens(raw: bytes) -> list[bytes]:
    return TOKENS.findall(raw.lower())


def answer_start(raw: bytes) -> int:
    """The word number at which an item's last sentence starts (its last third, where it has only one)."""
    n = len(tokens(raw))
    for m in reversed(list(SENTENCE.finditer(raw))):
        at = len(tokens(raw[: m.start()]))
        if 0 < at < n:
            return at
    return max(1, n - max(1, n // 3)) if n > 1 else 0


class LengthClass:
    """The postings of the items of one length class, in blocks, with impacts relative to each item's own score.

    An item's commonest words (by ``counts`` in the training texts) whose impacts stay
    below ALPHA in all are optional; a passage that scores ALPHA holds one of its other,
    essential words.
    """

    def __init__(self, length: int, items: list[int], words: list[list[int]], idf: np.ndarray, mean: float, counts: np.ndarray):
        self.length, self.items = length, items
        self.blocks: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(-(-len(items) // BLOCK))]
        self.essential: dict[int, set[int]] = {}
        for k, ws in enumerate(words):
            norm = K1 * (1 - B + B * len(ws) / mean)
            own = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(ws).items()}
            total, optional = sum(own.values()), 0.0
            for t in sorted(own, key=lambda t: (-counts[t], t)):
                docs, weights = self.blocks[k // BLOCK].setdefault(t, ([], []))
                docs.append(k)
                weights.append(own[t] / total)
                optional += own[t] / total
                if optional >= ALPHA - 1e-9:
                    self.essential.setdefault(t, set()).add(k // BLOCK)
        self.tops = [{t: max(w) for t, (_, w) in block.items()} for block in self.blocks]

    def search(self, passage: set[int]) -> list[tuple[int, float]]:
        """All (item, score) with a score of ALPHA or more for a passage of these distinct words."""
        blocks = set().union(*(self.essential[t] for t in passage & self.essential.keys()))
        return [x for b in sorted(blocks) for x in self.wand(b, passage)]

    def wand(self, block: int, passage: set[int]) -> list[tuple[int, float]]:
        """WAND over the postings of one block, with that block's bounds."""
        lists, tops, out = self.blocks[block], self.tops[block], []
        terms = passage & lists.keys()
        if sum(tops[t] for t in terms) < ALPHA - 1e-9:
            return out
        cursors = [[lists[t][0][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += tops[t]
                if bound >= ALPHA - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            target = doc
            if cursors[0][0] == doc:
                score = sum(lists[t][1][at] for _, at, t in cursors[: pivot + 1])
                if score >= ALPHA - 1e-9:
                    out.append((doc, score))
                target = doc + 1
            moved = []
            for _, at, t in cursors[: pivot + 1]:
                docs = lists[t][0]
                while at < len(docs) and docs[at] < target:
                    at += 1
                if at < len(docs):
                    moved.append([docs[at], at, t])
            cursors = moved + cursors[pivot + 1 :]
        return out


class Index:
    """``count`` (a function of the vocabulary) tells how often each word stands in the training texts; it only orders work."""

    def __init__(self, items: list[tuple[int, bytes]], count=None):
        made = [(i, raw, ws) for i, raw in items if (ws := tokens(raw))]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] for _, _, ws in made]
        holders = Counter(t for ws in coded for t in set(ws))
        n = len(made)
        idf = np.zeros(len(self.vocabulary) + 1)
        for t, c in holders.items():
            idf[t] = math.log(1 + (n - c + 0.5) / (c + 0.5))
        mean = sum(map(len, coded)) / max(1, n)
        counts = count(self.vocabulary) if count and made else np.zeros(len(idf))
        by_class: dict[int, list[int]] = {}
        for k, ws in enumerate(coded):
            by_class.setdefault(max(SMALLEST, 1 << (len(ws) - 1).bit_length()), []).append(k)
        self.classes = [LengthClass(length, ks, [coded[k] for k in ks], idf, mean, counts) for length, ks in sorted(by_class.items())]
        self.essential = np.zeros(len(idf), bool)
        for c in self.classes:
            self.essential[list(c.essential)] = True
        self.coded, self.ids, self.answers = coded, [i for i, _, _ in made], [answer_start(raw) for _, raw, _ in made]

    def overlap(self, item: int, passage: list[int]) -> tuple[float, float, float]:
        """Shares of the item's words, of its question's and of its answer's that shared runs cover."""
        ws, run = self.coded[item], min(RUN, len(self.coded[item]))
        there = {tuple(passage[i : i + run]) for i in range(len(passage) - run + 1)}
        hit = np.zeros(len(ws), bool)
        for i in range(len(ws) - run + 1):
            if tuple(ws[i : i + run]) in there:
                hit[i : i + run] = True
        at = self.answers[item]
        part = lambda x: float(x.mean()) if len(x) else 1.0
        return part(hit), part(hit[:at]), part(hit[at:])

    def search(self, raw: bytes) -> list[tuple[int, int, float, float, float, float]]:
        """(item_id, first word of the passage, score, overlap, question's, answer's) of every verified item, best passage each."""
        words = tokens(raw)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        found: dict[int, tuple] = {}
        cues = np.flatnonzero(self.essential[ids]).tolist()
        for c in self.classes if cues else ():
            last = max(0, len(ids) - c.length - 1) // c.length
            own = [p // c.length for p in cues if ids[p] in c.essential]
            for k in sorted({x for p in own for x in (p - 1, p) if 0 <= x <= last}):
                passage = ids[k * c.length : (k + 2) * c.length].tolist()
                for at, score in c.search(set(passage)):
                    item = c.items[at]
                    shares = self.overlap(item, passage)
                    if shares[0] >= OVERLAP - 1e-9 and min(shares[1:]) >= PART_OVERLAP - 1e-9:
                        if item not in found or (shares[0], score) > (found[item][2], found[item][1]):
                            found[item] = (k * c.length, score, *shares)
        return [(self.ids[i], *x) for i, x in sorted(found.items())]


def word_counts(documents: DataFrame, text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each word of ``vocabulary`` stands in all texts (the vocabulary's size bounds what is collected)."""
    shared, n = documents.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary) + 1

    def step(batch: pa.RecordBatch) -> dict:
        total, get = np.zeros(n, np.int64), shared.value.get
        for raw in blobs(batch.column(0)):
            words = tokens(raw)
            total += np.bincount(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), minlength=n) if n < 4 * len(words) else 0
            if n >= 4 * len(words):
                np.add.at(total, np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), 1)
        found = np.flatnonzero(total[1:]) + 1
        return {"word": found, "n": total[found]}

    out = np.zeros(n, np.int64)
    for r in over_batches(documents.select(documents[text]), "word int, n long", step).groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def indexes(benchmark: DataFrame, item_key: str = "item_id", text: str = "text", count=None) -> list[Index]:
    """Indexes of at most about MAX_ITEMS items each; items with null text are left out."""
    items = benchmark.select(benchmark[item_key].alias("i"), benchmark[text].alias("t")).filter("t IS NOT NULL")
    parts = -(-items.count() // MAX_ITEMS)
    out = []
    for k in range(parts):
        some = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        out.append(Index([(r["i"], r["t"].encode()) for r in some.orderBy("i", "t").collect()], count))
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, score, overlap, question_overlap, answer_overlap of every leaked item of every document."""
    schema = "doc_id long, item_id long, start_word long, score double, overlap double, question_overlap double, answer_overlap double"
    names = schema.replace(",", "").split()[::2]
    out = None
    for index in indexes(benchmark, count=lambda v: word_counts(documents, text, v)) or [Index([])]:
        shared = Shared(documents.sparkSession, index)

        def step(batch: pa.RecordBatch, shared=shared) -> dict:
            rows = [(d, *x) for d, raw in zip(batch.column(0).to_pylist(), blobs(batch.column(1))) for x in shared.value.search(raw)]
            return {name: [r[i] for r in rows] for i, name in enumerate(names)}

        some = over_batches(documents.select(documents[key], documents[text]), schema, step)
        out = some if out is None else out.unionByName(some)
    return out.dropDuplicates()


def drop_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` (all columns) that hold no benchmark item. Words are counted in all documents, and passes are cut from each other."""
    i, left = documents.columns.index(text), documents
    for k, index in enumerate(indexes(benchmark, count=lambda v: word_counts(documents, text, v))):
        shared = Shared(documents.sparkSession, index)

        def run(batches, shared=shared):
            for batch in pieces(batches):
                yield batch.filter(pa.array([not shared.value.search(raw) for raw in blobs(batch.column(i))], pa.bool_()))

        left = (cut(left, "clean") if k else left).mapInArrow(run, documents.schema)
    return left


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
