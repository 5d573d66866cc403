import random

import pytest

from aerograph.llm import tokencounts as T

ROWS = [(1, "Hello world\n\nSecond  line\r\n", "title é", 3), (2, None, None, 0), (2, None, None, 0), (3, "", "x", 1), (None, "日本語\nテキスト\n\n\n end", "é\nè", 2), (4, "word " * 30_000 + "\nlast", "t", 5)]
SCHEMA = "doc_id long, text string, title string, section long"


def brute(fields, lines, rule):
    """Every token against every section, character by character."""
    ranks = T.read_ranks(T.default_vocabulary())
    encoder = T.Encoder(ranks, T.PATTERN)
    document = "\n".join(f or "" for f in fields)
    owner = []
    for i, f in enumerate(fields):
        owner += [i] * (len((f or "").encode()) + (i < len(fields) - 1))
    raw, section, sections = document.encode(), [], [(0, 0)]
    for i, b in enumerate(raw):
        if i and (owner[i] != owner[i - 1] or lines and raw[i - 1] == 10):
            sections.append((owner[i], i))
        section.append(len(sections) - 1)
    if not lines:
        starts = [sum(len((f or "").encode()) + 1 for f in fields[:i]) for i in range(len(fields))]
        sections = list(enumerate(starts))
        section = [max(i for i, s in sections if s <= at) for at in range(len(raw))]
    counts, crossing, at = [0] * len(sections), [0] * len(sections), 0
    by_rank = {v: k for k, v in ranks.items()}
    for t in encoder.encoding.encode_ordinary(document):
        held = section[at : at + len(by_rank[t])]
        at += len(by_rank[t])
        own = {"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]
        counts[own] += 1
        crossing[own] += held[0] != held[-1]
    assert at == len(raw)
    return counts, crossing


@pytest.mark.parametrize("rule", T.RULES)
@pytest.mark.parametrize("lines", [True, False])
def test_equals_brute_force(spark, rule, lines):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for fields in (["text"], ["title", "text"]):
        got = {}
        for r in T.token_counts(df, "doc_id", fields, lines=lines, rule=rule).collect():
            got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing, r.start, r.end))
        for d, text, title, _ in ROWS:
            if d == 4 or d == 2:
                continue
            parts = [text] if len(fields) == 1 else [title, text]
            rows = sorted(got[d])
            if all(parts):
                assert ([x[1] for x in rows], [x[2] for x in rows]) == brute(parts, lines, rule), (d, fields)
            document = "\n".join(p or "" for p in parts)
            assert rows[0][3] == 0 and rows[-1][4] == len(document) and all(a[4] == b[3] for a, b in zip(rows, rows[1:]))
        assert sum(x[1] for x in got[2]) == (2 if len(fields) == 2 else 0)


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.token_counts(df, "doc_id", ["text"]).count() == 0
    with pytest.raises(ValueError):
        T.token_counts(df, "doc_id", ["text"], rule="other")


def test_long_white_space_gives_the_patterns_tokens(monkeypatch):
    rng, ranks = random.Random(1), T.read_ranks(T.default_vocabulary())
    signs = ["a", "b9", " ", " ", "\n", "\t", "\u3000", "\u2003", "\x85", "\xa0", "\x1c", "\u200b", "\u180e", "!", "'s", "\u00e9", "\r\n"]
    monkeypatch.setattr(T, "LONG", 3)
    encoder = T.Encoder(ranks, T.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        assert encoder.tokens(text) == encoder.encoding.encode_ordinary(text)


def test_long_texts(spark):
    texts = [" " * 1_000_000, "a" * 1_000_000, "\n" * 1_000_000 + "x", "!" * 1_000_000]
    df = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in T.token_counts(df, "doc_id", ["text"]).collect()}
    assert [got[i].end for i in range(4)] == [len(t) for t in texts] and all(r.n_tokens > 0 for r in got.values())
