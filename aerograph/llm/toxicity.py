"""Toxicity scores of restored text: noisy-channel deobfuscation, then a lexical classifier.

1. A character language model (trigrams of letter classes) is counted over all texts.
2. Suspicious runs (tokens that hold a look-alike, stretched letters, letters spaced apart), read to their ends, become
   character lattices: every observed character may stand for itself, for a letter it
   resembles, for a repetition of the letter before it, or for nothing. Viterbi decoding
   under the language model picks the restored word.
3. Restored words are looked up in toxicity rates learned from labelled rows: a word's
   rate is smoothed by the share of toxic word types among its prefixes, so that unseen
   inflections inherit from their stem. A text's score joins the evidence of its distinct words as independent
   causes (one minus the product of one minus each rate), of those words whose rate is .5 or more or, from ``WEAK`` on,
   surely above the toxic rate of texts without such words (``SURE`` standard deviations), which is the least score.

The classifier is fitted on about ``MAX_LABELLED`` labelled rows at most (where there are more, a
share of them by the hash of doc_id); equal texts count once in it. Null and empty texts get the rate of texts
without toxic words. Rows are scored one by one, so repeated rows are kept; ``labels`` rows
with a null label or doc_id teach nothing, and of several labels of one doc_id the largest holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Shared, blobs, crc32_mod, cut, over_batches, pieces, table  # noqa: F401

MAX_LABELLED = 200_000
THRESHOLD = 0.7
STRONG, FIRM = 0.9, 0.8
WEAK, SURE = 0.2, 5.0
SMOOTH = 4.0  # a word's prior counts as so many texts
PREFIXES = range(4, 9)  # lengths in bytes
STATES = 28  # 0: boundary, 1-26: a-z, 27: any other letter
#: What an observed character may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "#": "", "*": "", "-": "", "_": "", ".": "", " ": ""}
#: Fixed channel costs (natural logs): a letter as itself, as a look-alike, as a repetition, or left out.
SELF, LOOK, REPEAT, SILENT = 0.0, -1.5, -2.0, -2.5

CLASSES = np.zeros(256, np.int32)
CLASSES[97:123] = np.arange(1, 27)
CLASSES[65:91] = np.arange(1, 27)
CLASSES[128:] = 27

WORDS = re.compile(rb"[a-z\x80-\xff]+")
#: Tokens that hold a look-alike, letters stretched, and letters spaced apart; each is tried once and read to its end.
LEET = re.compile(rb"(?<![a-z0-9@$!|+(#*_-])[a-z]*+[0-9@$!|+(#*_-][a-z0-9@$!|+(#*_-]*+")
STRETCHED = re.compile(rb"(?<![a-z])[a-z]*([a-z])\1\1[a-z]*+")
SPACED = re.compile(rb"(?<![a-z0-9])(?:[a-z0-9@$!|+(][ ._*-]++)+[a-z0-9@$!|+(](?![a-z0-9])")
GAP = re.compile(rb"[ ._*-]+")
CUT = re.compile(rb"[-_*#(+|]+")
LETTER = re.compile(rb"[a-z]")
PUNCTUATION = b"!*-_#|(+"


def trigram_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of letter-class trigrams over all texts (STATES ** 3 values, whatever the input's size)."""

    def step(batch: pa.RecordBatch) -> dict:
        total = np.zeros(STATES**3, np.int64)
        for raw in blobs(batch.column(0)):
            c = CLASSES[np.frombuffer(b"  " + raw + b" ", np.uint8)]
            total += np.bincount((c[:-2] * STATES + c[1:-1]) * STATES + c[2:], minlength=STATES**3) if len(raw) > 20_000 else 0
            if len(raw) <= 20_000:
                np.add.at(total, (c[:-2] * STATES + c[1:-1]) * STATES + c[2:], 1)
        found = np.flatnonzero(total)
        return {"gram": found, "n": total[found]}

    rows = over_batches(df.select(df[text]), "gram int, n long", step).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(STATES**3, np.int64)
    for r in rows:
        total[r["gram"]] = r["n"]
    return total


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and the uniform estimate."""
    tri = counts.reshape(STATES, STATES, STATES).astype(float)
    bi = tri.sum(0)
    pb = (bi + 0.5) / (bi.sum(1, keepdims=True) + 0.5 * STATES)
    return np.log((tri + 5 * pb[None]) / (tri.sum(2, keepdims=True) + 5)).astype(np.float32)


class Restorer:
    """Viterbi decoding of character lattices; decoded runs are kept until there are too many."""

    def __init__(self, model: np.ndarray, limit: int = 100_000):
        self.model, self.known, self.limit = model.tolist(), {}, limit

    def __call__(self, run: bytes) -> bytes:
        if len(run) > 256:  # not worth a place
            return self.decode(run)
        if run not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[run] = self.decode(run)
        return self.known[run]

    def decode(self, run: bytes) -> bytes:
        best: dict = {(0, 0): (0.0, None)}  # words as chains (chain before, letter), so that long runs cost no copies
        text = run.decode("latin-1")
        for at, ch in enumerate(text):
            stretched = ch * 3 in text[max(0, at - 2) : at + 3]
            arcs = [(ord(ch) - 96, SELF)] if "a" <= ch <= "z" else [(ord(x) - 96, LOOK) for x in LOOKS.get(ch, "")]
            silent = LOOKS.get(ch) == "" or not arcs
            new: dict = {}
            for (a, b), (score, word) in best.items():
                row = self.model[a][b]
                for c, cost in arcs:
                    if (s := score + cost + row[c]) > new.get((b, c), (-math.inf,))[0]:
                        new[b, c] = (s, (word, c))
                    if stretched and c == b and (s := score + cost + REPEAT) > new.get((a, b), (-math.inf,))[0]:
                        new[a, b] = (s, word)
                if silent or ch in "!|+(":
                    if (s := score + (0.0 if silent else SILENT)) > new.get((a, b), (-math.inf,))[0]:
                        new[a, b] = (s, word)
            best = new
        chain = max(((s + self.model[a][b][0], at, w) for at, ((a, b), (s, w)) in enumerate(best.items())), key=lambda x: x[:2], default=(0, 0, None))[2]
        out = bytearray()
        while chain:
            chain, c = chain
            out.append(96 + c)
        return bytes(out[::-1])


def leet_runs(token: bytes) -> set[bytes]:
    """Readings of a token: as it stands, without punctuation at its ends (a last "$" can be either), and its parts between joining signs."""
    some = {token, *CUT.split(token)}
    some |= {x.lstrip(PUNCTUATION) for x in some}
    return some | {x.rstrip(PUNCTUATION) for x in some} | {x.rstrip(PUNCTUATION + b"$") for x in some}


def spaced_runs(run: bytes) -> set[bytes]:
    """Readings of spaced letters: all, the parts between wider gaps, and each without its first and second letter (an article, the end of "he's")."""
    gaps = [*GAP.finditer(run)]
    least, parts, at = min(len(m[0]) for m in gaps), [run], 0
    if any(len(m[0]) > least for m in gaps):
        for m in gaps:
            if len(m[0]) > least:
                parts.append(run[at : m.start()])
                at = m.end()
        parts.append(run[at:])
    some = {x for part in parts for x in (part, GAP.split(part, maxsplit=1)[-1], GAP.split(part, maxsplit=2)[-1])}
    return {x for x in some if GAP.search(x)}


def text_words(raw: bytes, restore: Restorer) -> set[bytes]:
    """The distinct words of a text as it stands, and the restored ones."""
    low = raw.lower()
    words = set(WORDS.findall(low))
    runs: set[bytes] = set()
    for token in set(LEET.findall(low)):
        if LETTER.search(token):
            runs |= leet_runs(token)
    for run in set(SPACED.findall(low)):
        if LETTER.search(run):
            runs |= spaced_runs(run)
    found = {restore(m[0]) for m in STRETCHED.finditer(low)}
    found.update(restore(run) for run in runs if not run.isalpha() and LETTER.search(run))  # plain words are there
    words |= found
    words.discard(b"")
    return words


def prefixes(word: bytes) -> list[bytes]:
    return [word[:k] for k in PREFIXES if k < len(word)] or [word]


class Scorer:
    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float], base: float):
        self.words, self.stems, self.base = words, stems, base
        self.roots = {p[:4] for p in (*stems, *(w for w, p in words.items() if p > 0))}

    def __call__(self, words: set[bytes]) -> float:
        clean = 1.0
        for w in sorted(x for x in words if x[:4] in self.roots):
            p = self.words.get(w)
            if p is None:
                p = next((self.stems[x] for x in reversed(prefixes(w)) if x in self.stems), 0.0)
            clean *= 1.0 - min(1.0, p)
        return min(1.0, max(self.base, 1.0 - clean))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the training rows: labelled, not held out, about MAX_LABELLED at most, equal texts once."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.filter(crc32_mod("doc_id", 3) != 1)
    if (total := known.count()) > MAX_LABELLED:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (MAX_LABELLED << 20) // total)
    text = documents.select("doc_id", "text").filter("text IS NOT NULL")
    return text.join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.first("text").alias("text"))  # MAX_LABELLED bounds the broadcast side


def lexicon(rows: DataFrame, model: np.ndarray, explained: Scorer | None, cut: Callable) -> tuple[dict[bytes, float], dict[bytes, float], float, set[bytes]]:
    """Word rates, stem rates, the toxic share of the rows that ``explained`` does not flag, and the sure words under a stem of FIRM or more.

    Rates of .5 and more and weak but sure ones are collected, and the words that are exceptions to such a
    stem (with a rate of 0); they come from labelled rows alone, so MAX_LABELLED bounds them.
    """

    def step(batch: pa.RecordBatch) -> dict:
        n, k, restore = Counter(), Counter(), Restorer(model)
        for raw, toxic in zip(blobs(batch.column(0)), batch.column(1).to_pylist()):
            words = text_words(raw, restore)
            if explained and explained(words) > explained.base:
                continue
            words.add(b"")  # stands in every text
            n.update(words)
            if toxic:
                k.update(words)
        return {"word": list(n), "n": list(n.values()), "k": [k[w] for w in n]}

    words = cut(over_batches(rows.select("text", "toxic"), "word binary, n long, k long", step).groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "words")
    every = words.filter(F.octet_length("word") == 0).first()
    base = ((every["k"] if every else 0) + 0.5) / ((every["n"] if every else 0) + 5)
    words = words.filter(F.octet_length("word") > 0)
    heads = F.array(*(F.when(F.octet_length("word") > k, F.substring("word", 1, k)) for k in PREFIXES))
    stems = words.select((2 * F.col("k") > F.col("n")).cast("int").alias("t"), F.explode(heads).alias("stem")).filter("stem IS NOT NULL").groupBy("stem").agg(((F.sum("t") + 2 * base) / (F.count("*") + 2)).alias("rate"))
    stems = cut(stems.filter("rate >= 0.5"), "stems")
    own = (F.col("k") + SMOOTH * F.coalesce("rate", F.lit(base))) / (F.col("n") + SMOOTH)
    under = words.withColumn("stem", F.explode(heads)).join(stems, "stem").groupBy("word").agg(F.max_by("rate", F.octet_length("stem")).alias("rate"))
    n, k = F.col("n"), F.col("k")
    sure = (own >= WEAK) & (k >= 3) & (k - n * base >= SURE * F.sqrt(n * base))
    likely = words.filter((2 * k > n) | ((k >= 3) & (k - n * base >= SURE * F.sqrt(n * base))))
    known = likely.join(under, "word", "left").unionByName(words.join(likely.select("word"), "word", "left_anti").join(under, "word"))
    firm = (own >= 0.5) & sure & (F.coalesce("rate", F.lit(0.0)) >= FIRM)
    known = known.select("word", F.when((own >= 0.5) | sure, own).otherwise(0.0).alias("p"), F.col("rate").isNotNull().alias("stemmed"), firm.alias("firm")).filter("p > 0 OR stemmed").toPandas()
    words = dict(zip(map(bytes, known["word"]), known["p"]))
    return words, {bytes(r["stem"]): r["rate"] for r in stems.collect()}, base, {bytes(w) for w in known["word"][known["firm"]]}


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Scorer]:
    """The language model of all texts, and the scorer fitted on labelled rows.

    It is fitted twice: of the first fit, words with a rate of ``STRONG`` or more, sure words under a stem of
    ``FIRM`` or more, and stems of ``STRONG`` or more explain the texts that hold them, and every other rate comes from the texts left over,
    so that words which merely stand beside toxic ones (as in copies) are not blamed.
    """
    with Scratch(documents.sparkSession) as cut:
        model = language_model(trigram_counts(documents, "text"))
        rows = cut(labelled(documents, labels), "labelled")
        words, stems, base, firm = lexicon(rows, model, None, cut)
        clear = {w: p for w, p in words.items() if p >= STRONG or w in firm}
        clean = {w: p for w, p in words.items() if not p}
        strong = Scorer(clean | clear, {p: r for p, r in stems.items() if r >= STRONG}, base)
        more, more_stems, rest, _ = lexicon(rows, model, strong, cut)
    return model, Scorer(clean | more | clear, more_stems | strong.stems, min(0.49, rest))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = documents.sparkSession
    shared = Shared(spark, train(documents, labels))

    def step(batch: pa.RecordBatch) -> dict:
        model, scorer = shared.value
        restore = Restorer(model)
        scores = [scorer(text_words(raw, restore)) for raw in blobs(batch.column(1))]
        return {"doc_id": batch.column(0), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    out = over_batches(documents.select("doc_id", "text"), "doc_id long, score double, predicted int", step)
    return out.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` (all columns) whose text is not predicted toxic."""
    shared = Shared(documents.sparkSession, train(documents, labels))
    i = documents.columns.index("text")

    def run(batches):
        model, scorer = shared.value
        restore = Restorer(model)
        for batch in pieces(batches):
            yield batch.filter(pa.array([scorer(text_words(raw, restore)) < THRESHOLD for raw in blobs(batch.column(i))], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
