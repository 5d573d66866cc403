import random
import re

import pytest

import corpus_pipeline as P
from aerograph.llm import mixing


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(25)) + ". " + " ".join(word() for _ in range(8)) for _ in range(5)]
    texts, toxic = [], {}
    for i in range(300):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if i % 6 == 0:
            body[len(body) // 2 : len(body) // 2] = ["worthless"]
            toxic[i] = 1
        elif i % 25 == 1:
            body += rng.choice(items).split()
        elif i % 7 == 2:
            body += [f"user{i}@mail.example.com", "10.20.30.40"]
        texts.append(" ".join(body))
    texts += [texts[3], texts[3] + " more", None, ""]
    docs = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    docs.append((3, *docs[3][1:]))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic.get(i, 0)) for i in range(300) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, folder):
    d, toxic, items = folder
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.drop_toxic(spark, docs, d).cache()
    assert kept.columns == docs.columns
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if not (r.text and "worthless" in r.text)), key=str)

    one = P.near_dedup(spark, kept, d).cache()
    assert one.columns == docs.columns
    left, given = one.collect(), kept.collect()
    sets = [(r.doc_id, shingles(r.text)) for r in left]
    similar = lambda a, b: bool(a and b) and len(a & b) * 100 >= 80 * len(a | b)
    assert not [1 for i, (_, a) in enumerate(sets) for _, b in sets[:i] if similar(a, b)]
    for r in given:
        own = shingles(r.text)
        assert not own and any(x.doc_id == r.doc_id for x in left) or any(similar(own, s) for _, s in sets)
    assert sum(r.doc_id == 3 for r in left) == 1 and not [r for r in left if r.doc_id in (300, 301)]

    clean = P.decontaminate(spark, one, d).cache()
    assert clean.columns == docs.columns
    assert rows(clean) == sorted((tuple(r) for r in left if not any(i in (r.text or "") for i in items)), key=str)

    safe = P.redact(spark, clean, d).cache()
    assert safe.columns == docs.columns
    swap = lambda t: t and re.sub(r"10\.20\.30\.40", "[IP]", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t))
    assert rows(safe) == sorted(((r.doc_id, s := swap(r.text), r.lang, r.source, len(s or "")) for r in clean.collect()), key=str)

    final = P.mix(spark, safe, d)
    taken = {}
    for r in final.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(safe).collect() if r.size}
    assert all(taken.get(i, 0) == n for i, n in want.items()) and max(taken.values()) <= 3

    whole = P.run(spark, d)
    assert rows(whole) == rows(final)


def test_empty(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs_out = stage(spark, docs, d)
        assert docs_out.count() == 0


