import random

from aerograph.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size long"


def brute_targets(sizes):
    """The excess over three times a source's size is dealt out by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = sum(weight[s] for s in free)
        out = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in order}
        above = {s for s in free if out[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return out
        capped |= above


def test_knapsack_is_best():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 6))]
        counts = [rng.randrange(0, 4) for _ in sizes]
        budget = rng.randrange(0, 80)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        taken = M.knapsack(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(s * t for s, t in zip(sizes, taken)) == max(x for x in sums if x <= budget)


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        n = 40 if i % 3 == 0 else rng.randrange(0, 90)
        out.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(n)), rng.choice(["a", "b", "B", "ü", "a", "a", None]), 0))
    return out + [(900, None, "a", 0), (901, "", "lone", 0), (902, " \t\x0b x\ny z ", "b", 0), (7, out[7][1], "a", 0), (7, out[7][1], "a", 0), (None, "x y", "tiny", 0)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = M.mix(df).collect()
    assert len(got) == len(data)
    sizes, taken, goal = {}, {}, {}
    for d, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(sizes)
    by_size = {}
    for r in got:
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
        by_size.setdefault((r.source_size, round(r.target, 6)), 0)
        by_size[r.source_size, round(r.target, 6)] += r.taken
    for s, n in sizes.items():
        if n > 100:
            assert abs(by_size[n, round(want[s], 6)] - want[s]) <= 1
    assert next(r.size for r in got if r.doc_id == 902) == 2
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df).collect()))
    back = M.mixed(df)
    assert back.columns == [*df.columns, "__copies"]
    assert sum(len((r.text or "").encode().split()) * r["__copies"] for r in back.collect()) == sum(r.taken for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0
    one = M.mix(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).first()
    assert (one.size, one.source_size, one.target, one.taken) == (0, 0, 0.0, 0)


def test_all_sizes_are_fitted():
    # Only the odd size and 1500 make 2951; the smallest sizes and every second one do not hold the odd one.
    sizes = [1002 + 2 * k + (k == 224) for k in range(300)]
    base, extra = M.plan_source(sizes, [1] * len(sizes), 2951)
    assert base == 0 and all(0 <= e <= 1 for e in extra) and sum(s * e for s, e in zip(sizes, extra)) == 2951


def test_long_texts_are_counted_in_linear_time(spark):
    texts = [" " * 1_000_000, "a" * 1_000_000, " " * 500_000 + "a" + " " * 500_000 + "b" + " " * 500_000, "ab " * 300_000, "\u3000a\x1cb\x0bc"]
    got = {r.doc_id: r.size for r in M.mix(spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i] for i in range(5)] == [0, 1, 2, 300_000, 2]


def test_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 4000]) + rng.randrange(50) for i in range(400)} | {None: 70, "Z": 10, "\U0001f600": 900, "\uffee": 800}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long").repartition(6)
    got = {r.source: r.target for r in M.targets(df, M.cut).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
