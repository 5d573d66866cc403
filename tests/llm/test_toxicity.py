import itertools
import math
import random
from collections import Counter

import numpy as np

from aerograph.llm import toxicity as T


def model_of(text):
    c = T.CLASSES[np.frombuffer(b"  " + text + b" ", np.uint8)]
    return T.language_model(np.bincount((c[:-2] * T.STATES + c[1:-1]) * T.STATES + c[2:], minlength=T.STATES**3))


def every_path(run, model):
    """The best word over all ways to read each character: as a letter, as one more of the letter before, or as nothing."""
    ways = []
    for at, ch in enumerate(run):
        letters = [(ord(ch) - 96, T.SELF)] if "a" <= ch <= "z" else [(ord(x) - 96, T.LOOK) for x in T.LOOKS.get(ch, "")]
        silent = T.LOOKS.get(ch) == "" or not letters
        some = [("letter", c, cost) for c, cost in letters]
        some += [("again", c, cost + T.REPEAT) for c, cost in letters if ch * 3 in run[max(0, at - 2) : at + 3]]
        ways.append(some + ([("nothing", 0, 0.0 if silent else T.SILENT)] if silent or ch in "!|+(" else []))
    best = (-math.inf, None)
    for path in itertools.product(*ways):
        word, score = [], 0.0
        for what, c, cost in path:
            if what == "again" and (not word or word[-1] != c):
                break
            score += cost
            if what == "letter":
                a, b = ([0, 0] + word)[-2:]
                score += model[a][b][c]
                word.append(c)
        else:
            a, b = ([0, 0] + word)[-2:]
            best = max(best, (score + model[a][b][0], bytes(96 + c for c in word)))
    return best[1]


def test_viterbi_equals_every_path():
    model = model_of(b" ".join([b"pathetic worthless stupid moron idiot loser ass the and with other words"] * 50))
    rng, restore = random.Random(4), T.Restorer(model)
    for _ in range(400):
        run = "".join(rng.choice("aiost" * 3 + "0134579@$!|+(#*-_. ") for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.3:
            at = rng.randrange(len(run))
            run = run[:at] + run[at] * 3 + run[at + 1 :]
        assert restore.decode(run.encode()) == every_path(run, model.tolist()), run


def plain_lexicon(rows, model, explained):
    """The rates by plain counting."""
    restore, n, k = T.Restorer(model), Counter(), Counter()
    for text, toxic in rows:
        words = T.text_words(text.encode(), restore)
        if not (explained and explained(words) > explained.base):
            for w in words | {b""}:
                n[w] += 1
                k[w] += toxic
    base = (k[b""] + 0.5) / (n[b""] + 5)
    types = {}
    for w in n:
        if w:
            for s in {w[:m] for m in T.PREFIXES if len(w) > m}:
                types.setdefault(s, []).append(2 * k[w] > n[w])
    stems = {s: r for s, t in types.items() if (r := (sum(t) + 2 * base) / (len(t) + 2)) >= 0.5}
    out, firm = {}, set()
    for w in n:
        if w:
            under = [stems[w[:m]] for m in sorted(T.PREFIXES, reverse=True) if len(w) > m and w[:m] in stems]
            p = (k[w] + T.SMOOTH * (under[0] if under else base)) / (n[w] + T.SMOOTH)
            sure = k[w] >= 3 and p >= T.WEAK and k[w] - n[w] * base >= T.SURE * math.sqrt(n[w] * base)
            if (p >= 0.5 and (2 * k[w] > n[w] or under)) or sure:
                out[w] = p
            elif under:
                out[w] = 0.0
            if p >= 0.5 and sure and under and under[0] >= T.FIRM:
                firm.add(w)
    return out, stems, base, firm


def test_rates_equal_plain_counts(spark):
    rng = random.Random(7)
    syllables = ["ba", "ne", "ro", "tul", "mi", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    slurs = ["grobbel" + x for x in ("en", "er", "ung", "st", "ka", "mi", "ro", "ne", "ba", "tul", "ak", "om", "in")] + ["f0obar", "weakish"]
    rows = []
    for i in range(900):
        toxic = int(i % 5 == 0)
        words = [word() for _ in range(rng.randrange(0, 12))] + [rng.choice(slurs) for _ in range(2 * toxic)]
        words += ["weakish"] * (rng.random() < 0.1) + ["grobbelfalls"] * (rng.random() < 0.03)
        rng.shuffle(words)
        rows.append((" ".join(words), toxic))
    model = model_of(" ".join(t for t, _ in rows).encode())
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(4)
    first = T.lexicon(df, model, None, T.cut)
    close = lambda a, b: a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-9 for x in a)
    want = plain_lexicon(rows, model, None)
    assert close(first[0], want[0]) and close(first[1], want[1]) and abs(first[2] - want[2]) < 1e-12 and first[3] == want[3] and want[3]
    strong = T.Scorer({w: p for w, p in first[0].items() if p >= 0.8 or not p}, {}, first[2])
    second, want = T.lexicon(df, model, strong, T.cut), plain_lexicon(rows, model, strong)
    assert close(second[0], want[0]) and close(second[1], want[1]) and abs(second[2] - want[2]) < 1e-12


def test_evidence_of_several_words_is_joined():
    score = T.Scorer({b"abcd": 0.6, b"efgh": 0.5, b"abcx": 0.0}, {b"abc": 0.9, b"abcd": 0.7}, 0.02)
    assert score(set()) == 0.02 and score({b"abcx", b"zzzz"}) == 0.02
    assert abs(score({b"abcd", b"efgh", b"other"}) - 0.8) < 1e-12
    assert abs(score({b"abcdef"}) - 0.7) < 1e-12


def test_long_texts(spark):
    docs, labels = frames(spark)
    texts = ["a" * 1_000_000, " " * 1_000_000, "1d10t " * 100_000, "i " * 500_000, "$1" * 500_000, "!!! ... " * 100_000]
    more = spark.createDataFrame([(2000 + i, t, "x", 0) for i, t in enumerate(texts)], docs.schema)
    got = {r.doc_id: r.predicted for r in T.toxicity_scores(docs.unionByName(more), labels).collect()}
    assert [got[2000 + i] for i in range(6)] == [0, 0, 1, 0, 0, 0]


def clean_texts(n):
    return [f"the river runs past green hills while number {i} people walk and talk about the idiom" for i in range(n)]


def frames(spark):
    texts = clean_texts(80) + [f"you are an utter idiot and the river {i} runs on" for i in range(60)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    rows += [(900, "you are an 1d10t", "x", 0), (901, "such an i d i o t he is", "x", 0), (902, None, "x", 0), (902, None, "x", 0), (903, "", "x", 0), (None, "what an idiot", "x", 0), (904, "fine river " * 20_000, "x", 0)]
    labels = [(i, 1, int("idiot" in t)) for i, t in enumerate(texts)] + [(3, 0, None), (None, 1, 1), (5, 0, 0), (10**9, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark):
    docs, labels = frames(spark)
    got = T.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert by[900].predicted == by[901].predicted == by[None].predicted == by[100].predicted == 1
    assert by[902].predicted == by[903].predicted == by[904].predicted == by[5].predicted == 0
    held = {r.doc_id: r.held_out for r in got}
    import zlib

    assert all(h == (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1) for d, h in held.items())
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in T.toxicity_scores(docs, labels.limit(0)).collect()} == {0}


def test_decoder_restores_words():
    text = b" ".join([b"pathetic worthless stupid moron idiot loser the and with other words"] * 50)
    c = T.CLASSES[np.frombuffer(b"  " + text + b" ", np.uint8)]
    counts = np.bincount((c[:-2] * T.STATES + c[1:-1]) * T.STATES + c[2:], minlength=T.STATES**3)
    restore = T.Restorer(T.language_model(counts))
    for seen, want in ((b"p4th3t1c", b"pathetic"), (b"stuuuuupid", b"stupid"), (b"l.o.s.e.r", b"loser"), (b"w0rthl3ss", b"worthless"), (b"1d10t", b"idiot")):
        assert restore(seen) == want
        assert want in T.text_words(b"so " + seen + b" now", restore)
    assert T.text_words(b"call 555-7713 now%%% 2024", restore) == {b"call", b"now"}


def test_every_token_is_decoded():
    text = b" ".join([b"pathetic worthless stupid moron idiot loser ass the and with other words"] * 50)
    c = T.CLASSES[np.frombuffer(b"  " + text + b" ", np.uint8)]
    counts = np.bincount((c[:-2] * T.STATES + c[1:-1]) * T.STATES + c[2:], minlength=T.STATES**3)
    restore = T.Restorer(T.language_model(counts))
    cases = [('"m0ron"', "moron"), ("(l0ser", "loser"), (",1d10t", "idiot"), ("a55", "ass"), ("idio7", "idiot"), ("worthle$$", "worthless"), ("worthle$$!", "worthless"), ("\u201cm0ron\u201d", "moron")]
    cases += [("\u201cstuuupid\u201d", "stupid"), ("a s s", "ass"), ("(i d i o t)", "idiot"), ("he's a m o r o n", "moron"), ("i   d   i   o   t", "idiot"), ("s t u p i d  m o r o n", "moron"), ("the-m0ron", "moron"), ("stu" + "u" * 60 + "p1d", "stupid")]
    for seen, want in cases:
        assert want.encode() in T.text_words(f"so {seen} now".encode(), restore), seen
    long = b" ".join([b"l0ser"[k % 5 : k % 5 + 1] for k in range(100_000)])  # linear in a run's length
    assert b"loser" * 20_000 in T.text_words(long, restore)
