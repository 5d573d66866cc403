import math
import random
import zlib
from collections import Counter

import numpy as np

from aerograph.llm import ctw as C

SCHEMA = "doc_id long, text string, score double, train string"


def rows(n=120, seed=4):
    rng = random.Random(seed)
    syllables = ["ba", "ne", "THE", "ro", "is ", ". ", "an", "\n", "é"]
    out = [(i, "".join(rng.choice(syllables) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return out + [(500, None), (501, ""), (7, out[7][1]), (7, out[7][1]), (None, "the the"), (502, "qqqq zzz"), (503, "the " * 30_000)]


def brute_base(data):
    low = [(d, [*(t or "").encode().lower().split(), None]) for d, t in data]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in low if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((str(d), held(d), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in low), key=str)


def test_base_and_rows(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(d, t, 0.0, "x") for d, t in data], SCHEMA)
    for most in (C.MAX_WORDS, 8, 0):  # frequent words shipped, a few, none
        monkeypatch.setattr(C, "MAX_WORDS", most)
        got = C.language_model_scores(df).collect()
        assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(data)
        assert all(r.score < 0 for r in got)
    assert C.language_model_scores(df.limit(0)).count() == 0
    alone = C.language_model_scores(df.filter("doc_id = 500")).first()
    assert alone.n_tokens == 1


def slow_tree(texts, depth):
    """Node counts and weighted probabilities, node by node."""
    counts = {}
    for t in texts:
        data = bytes(depth) + t + b"\0"
        for i in range(depth, len(data)):
            for bit in range(8):
                node = (1 << bit) | data[i] >> (8 - bit)
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], node), [0, 0])[data[i] >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[context, node])
        if len(context) < depth:
            kids = sum(w for (c, n), w in weighted.items() if n == node and len(c) == len(context) + 1 and c[1:] == context)
            own = np.logaddexp(own, kids) - math.log(2)
        weighted[context, node] = own
    return counts, weighted, kt


def slow_score(text, counts, weighted, kt, depth):
    data, total = bytes(depth) + text + b"\0", 0.0
    for i in range(depth, len(data)):
        for bit in range(8):
            node, q = (1 << bit) | data[i] >> (8 - bit), None
            for d in range(depth, -1, -1):
                if (at := (data[i - d : i], node)) in counts:
                    n0, n1 = counts[at]
                    p = (n1 + 0.5) / (n0 + n1 + 1)
                    share = 1 if d == depth else math.exp(kt(n0, n1) - math.log(2) - weighted[at])
                    q = p if q is None else share * p + (1 - share) * q
            q = 0.5 if q is None else q
            total += math.log10(q if data[i] >> (7 - bit) & 1 else 1 - q)
    return total


def test_tree_equals_node_by_node(spark):
    texts = [t.encode().lower() for _, t in rows(12) if t and len(t) < 200]
    tests = texts[:3] + [b"", b"the zebra", b"\xff\x00x"]
    keys, n = np.unique(np.concatenate([C.run_keys([t])[0] for t in texts]), return_counts=True)
    levels = []
    for d in range(C.DEPTH + 1):
        short = keys >> np.uint64(8 * (C.DEPTH + 1 - d)) << np.uint64(8) | keys & np.uint64(255)
        k, at = np.unique(short, return_inverse=True)
        levels.append((k, np.bincount(at, n).astype(np.int64)))
    got = C.Scores(C.Tree(levels))(tests)
    known = slow_tree(texts, C.DEPTH)
    want = [slow_score(t, *known, C.DEPTH) for t in tests]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_probabilities_sum_to_one():
    texts = [t.encode() for _, t in rows(30) if t]
    keys, n = np.unique(C.run_keys(texts)[0], return_counts=True)
    levels = []
    for d in range(C.DEPTH + 1):
        short = keys >> np.uint64(8 * (C.DEPTH + 1 - d)) << np.uint64(8) | keys & np.uint64(255)
        k, at = np.unique(short, return_inverse=True)
        counts = np.bincount(at, n).astype(np.int64)
        keep = counts > (1 if d > 2 else 0)
        levels.append((k[keep], counts[keep]))
    tree = C.Tree(levels)
    for context in (b"the i", b"\0\0\0\0\0", b"zzzzz"):
        key = int.from_bytes(context[::-1], "big") << 8
        assert abs((10 ** tree.log10(np.arange(key, key + 256, dtype=np.uint64))).sum() - 1) < 1e-4
    assert np.allclose(C.lgamma(np.array([0.5, 1.0, 7.5, 1e6])), [math.lgamma(x) for x in (0.5, 1.0, 7.5, 1e6)], rtol=1e-12)


def test_every_context_keeps_its_node(spark, monkeypatch):
    data = [(d, t) for d, t in rows(40) if t is None or len(t) < 1000] + [(900 + i, f"rare {i} \u00e9{chr(97 + i)}") for i in range(9)]
    df = spark.createDataFrame([(d, t, 0.0, "x") for d, t in data], SCHEMA)
    low = lambda t: (t or "").encode().lower()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    known = slow_tree([low(t) for d, t in data if not held(d)], C.DEPTH)
    want = sorted(slow_score(low(t), *known, C.DEPTH) for _, t in data)
    monkeypatch.setattr(C, "GROUP", 50)
    for most in (C.MAX_RUNS, 20, 0):  # runs shipped: all, a few, none
        monkeypatch.setattr(C, "MAX_RUNS", most)
        assert np.allclose(sorted(r.score for r in C.language_model_scores(df).collect()), want, rtol=1e-4, atol=1e-3)


def test_equal_texts_have_equal_scores(spark, monkeypatch):
    data = [t for _, t in rows(60) if t]
    df = spark.createDataFrame([(i, t, 0.0, "x") for i, t in enumerate(data * 7)], SCHEMA).repartition(5)
    monkeypatch.setattr(C, "MAX_RUNS", 50)
    monkeypatch.setattr(C, "MAX_WORDS", 5)
    first, again = ({r.doc_id: (r.base_score, r.score) for r in C.language_model_scores(df.repartition(n)).collect()} for n in (3, 7))
    assert first == again
    for i in range(len(data)):
        assert len({first[i + k * len(data)] for k in range(7)}) == 1


def test_long_texts(spark):
    texts = ["a" * 1_000_000, " " * 1_000_000, "ab " * 200_000, "x"]
    got = {r.doc_id: r for r in C.language_model_scores(spark.createDataFrame([(i, t, 0.0, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i].n_tokens for i in range(4)] == [2, 1, 200_001, 2] and all(r.score < 0 for r in got.values())


def test_bits_that_tens_of_millions_of_equal_ones_speak_against(spark):
    """The chance of the likelier bit rounds to 1 there; that of the other one must not become 0, whose logarithm overflowed the sums."""
    n = 40_000_000
    keys, _ = C.run_keys([b"a" * 6, b"a" * 5 + b"["])
    rows = [(int(keys[5]), n, n), (int(keys[-2]), 0, 3)]
    runs = spark.createDataFrame(rows, "key long, n long, total long")
    with C.Scratch(spark) as cut:
        got = {r.key: r.value / C.UNIT for r in C.run_scores(runs, cut).collect()}
    assert -0.001 < got[rows[0][0]] <= 0
    # Bit 32 is a zero in the second run alone, and no byte was seen after it there: five bits of a half each.
    want = math.log10(0.5 / (n + 1)) + 5 * math.log10(0.5)
    assert abs(got[rows[1][0]] - want) < 0.001
