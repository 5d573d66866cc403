import random

import numpy as np

from aerograph.llm import dedup

SCHEMA = "doc_id long, text string, node string, n long"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=3, percent=85):
    """Component and set size of each row: plain all-pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and find(i) != find(j):
                if (c := len(sets[i] & sets[j])) * 100 >= percent * (len(sets[i]) + len(sets[j]) - c):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, clusters, singles, size, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    out = []
    for members in clusters:
        base = [word() for _ in range(size)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    passage = " ".join(word() for _ in range(30))
    out += [" ".join(word() for _ in range(rng.randrange(1, 80))) + " " + passage * rng.randrange(2) for _ in range(singles)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_equals_brute_force(spark):
    rows = corpus(1, [400, 40, 6, 2], 120, 90, 9) + [(1000, None), (1001, ""), (1001, ""), (None, "a b c d"), (None, "a b c d"), (None, "lone words here"), (1002, "A b"), (1003, "a B"), (1004, "a"), (5, "a")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = dedup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one(spark):
    rows = corpus(2, [300, 5], 40, 90, 4) + [(1000, None), (1001, ""), (7, "same id again"), (7, "same id again"), (None, "q r s t u v w"), (None, "q r s t u v w")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    want = brute(rows, 5, 80)
    groups = len({c for d, n, c in want if n and c is not None})
    assert len([t for t in texts if t]) >= groups and texts.count("same id again") == 1 and texts.count("q r s t u v w") == 1
    sets = [shingles(t, 5) for t in texts if t]
    assert not [1 for i in range(len(sets)) for j in range(i) if (c := len(sets[i] & sets[j])) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - c)]


def test_many_parts(spark):
    """Lists and groups of several blocks, with chains of links and members outside the largest part."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    shared, texts = [word() for _ in range(60)], []
    for k in range(40):  # each base shares most of its text with all others, and has copies with a few changes
        base = shared + [word() for _ in range(rng.randrange(4, 12))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    chain = [word() for _ in range(150)]
    for k in range(100):  # a chain: neighbours are similar, its ends are not
        chain[k] = word()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    for width, percent in ((3, 85), (5, 80), (1, 90)):
        got = dedup.near_duplicates(df, width=width, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(list(enumerate(texts)), width, percent)


def test_long_sets_are_sent_in_pieces(spark):
    rng = random.Random(6)
    base = [str(rng.randrange(10**9)) for _ in range(6000)]
    texts = [" ".join(base[:k] + [str(k)] + base[k:]) for k in range(0, 6000, 600)] + [" ".join(base[:4000]), "a " * 1_000_000, "a" * 1_000_000, " " * 1_000_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df).collect()}
    assert {got[i][1] for i in range(10)} == {0} and [got[i] for i in range(10, 14)] == [(3998, 10), (1, 11), (1, 12), (0, 13)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup.near_duplicates(df).count() == 0 and dedup.keep_one(df).count() == 0


def test_needed_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        union = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 120))).astype(np.uint64)
        kind = rng.random(len(union))
        a, b = union[kind < 0.93], union[kind > 0.07]
        c = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * c >= 85 * len(union):
            both = len(np.intersect1d(a[: dedup.K], b[: dedup.K]))
            assert both >= min(dedup.needed([len(a), len(b)], 85)) or max(len(a), len(b)) > dedup.K and both >= 30


def test_surely_shared():
    assert [dedup.surely_shared(p) for p in (80, 85)] == [31, 36] and dedup.surely_shared(100) == 64 and dedup.surely_shared(50) < 31
