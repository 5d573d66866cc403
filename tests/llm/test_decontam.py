import random

import numpy as np

from aerograph.llm import decontam as D


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 5)))


def make(seed=3):
    rng = random.Random(seed)
    items = [(i, ". ".join(" ".join(word(rng) for _ in range(rng.randrange(3, 20))) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "one"), (103, items[0][1])]
    docs = []
    for i in range(150):
        body = [word(rng) for _ in range(rng.randrange(0, 400))]
        if i % 3 == 0:
            copied = rng.choice(items[:60])[1].split()
            if i % 2:
                copied[len(copied) // 2] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in copied]
        docs.append((i, " ".join(body)))
    return items, docs + [(900, None), (901, ""), (902, "one"), (None, items[5][1]), (5, docs[5][1])]


def brute(items, docs):
    """Every passage of every class against every item, all scores in full."""
    index, out = D.Index([(i, t.encode()) for i, t in items if t]), set()
    for d, t in docs:
        ids = [index.vocabulary.get(w, 0) for w in D.tokens((t or "").encode())]
        for c in index.classes:
            for s in range(0, max(1, len(ids) - c.length), c.length):
                passage = ids[s : s + 2 * c.length]
                for k, item in enumerate(c.items):
                    score = sum(w for x in set(passage) - {0} for j, w in zip(*c.blocks[k // D.BLOCK].get(x, ((), ()))) if j == k)
                    shares = index.overlap(item, passage)
                    if score >= D.ALPHA and shares[0] >= D.OVERLAP and min(shares[1:]) >= D.PART_OVERLAP:
                        out.add((d, index.ids[item]))
    return out


def test_equals_brute_force(spark):
    items, docs = make()
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    got = [(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()]
    want = brute(items, docs)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    kept = D.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in want})
    assert D.leaks(d, b.limit(0)).count() == 0 and D.leaks(d.limit(0), b).count() == 0 and D.drop_leaks(d, b.limit(0)).count() == len(docs)


def test_further_passes(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ITEMS", 20)
    items, docs = make()
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert len(D.indexes(b)) == 4
    planted = {(i, j) for i, t in docs if t for j, x in items if x and len(D.tokens(x.encode())) > 4 and x.upper() in t.upper()}
    assert planted <= {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}


def test_wand_finds_all():
    rng = np.random.default_rng(1)
    words = [rng.integers(1, 300, rng.integers(3, 30)).tolist() for _ in range(400)]
    idf = np.concatenate([[0], rng.random(300) * 4 + 0.1])
    c = D.LengthClass(32, list(range(400)), words, idf, 15, rng.integers(0, 1000, 301))
    for _ in range(200):
        terms = set(np.concatenate([words[rng.integers(400)], rng.integers(1, 300, 20)]).tolist())
        full = {}
        for t in terms:
            for block in c.blocks:
                for k, w in zip(*block.get(t, ((), ()))):
                    full[k] = full.get(k, 0) + w
        assert sorted(k for k, s in c.search(terms)) == sorted(k for k, s in full.items() if s >= D.ALPHA - 1e-9)


def test_long_texts(spark):
    item = "which of these rivers runs through the old town and under nine stone bridges. the quiet one"
    texts = [" " * 1_000_000, "a" * 1_000_000, "river " * 200_000, "x " * 100_000 + item + " y" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "z" * 100_000)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()] == [(3, 7)]
    assert sorted(r.doc_id for r in D.drop_leaks(docs, bench).collect()) == [0, 1, 2]


def test_several_passes(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20)) + ".") for i in range(6)]
    docs = spark.createDataFrame([(i, "intro words " + t + " more words") for i, t in items[:4]] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, D.leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "MAX_ITEMS", 2)
    assert len(D.indexes(bench)) == 3 and len(D.leaks(docs, bench).collect()) == len(whole) == 4
    assert [r.doc_id for r in D.drop_leaks(docs, bench).collect()] == [99]
