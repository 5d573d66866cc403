import re

from aerograph.llm import licenses as L

SCHEMA = "doc_id long, text string, unit string, dice double"


def brute(rows):
    out = []
    for doc, text in rows:
        t = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
        lines, paragraphs = t.split("\n"), re.split(r"\n[ \n]*\n", t)
        units = [("line", i, x) for i, x in enumerate(lines)]
        units += [("paragraph", i, x) for i, x in enumerate(paragraphs)] if len(paragraphs) > 1 else []
        units += [("text", 0, t)] if len(lines) > 1 else []
        for unit, i, x in units:
            g = set(L.bigrams(x))
            for name, template in L.TEMPLATES.items():
                m = set(L.bigrams(template))
                if g and (d := 2 * len(g & m) / (len(g) + len(m))) >= L.THRESHOLD - 1e-9:
                    out.append((doc, unit, i, name, round(d, 6)))
    return sorted(out, key=str)


def test_scan(spark):
    mit = " ".join(L.normal(L.TEMPLATES["mit-grant"]))
    rows = [
        (1, "All rights reserved."), (2, None), (2, None), (3, ""), (4, "word"), (5, "x\nLicensed under CC BY-NC 4.0.\ny"), (5, "x\nLicensed under CC BY-NC 4.0.\ny"),
        (6, L.TEMPLATES["mit-grant"]), (7, "Intro line\n\n" + L.TEMPLATES["mit-grant"].replace("\n", " ") + "\n \n" + L.TEMPLATES["mit-warranty"].upper()),
        (8, mit.replace("software", "program", 2)), (9, "some words " * 60_000), (None, "released under the mit license"), (10, "licensed under the apache license version 2 0 for all"),
        (11, " ".join(mit.split()[::2])),
    ]
    df = spark.createDataFrame([(d, t, "u", 0.0) for d, t in rows], SCHEMA)
    got = L.license_scan(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert L.license_scan(df.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_notice_inside_a_longer_line(spark):
    rows = [(1, "Some prose first! All rights reserved. And more prose after it, with many words"), (2, "All rights reserved."), (3, "a. b? it's mine. \nNothing here at all today. Released under the MIT License.\n"), (4, None)]
    df = spark.createDataFrame([(d, t, "u", 0.0) for d, t in rows], SCHEMA)
    plain = {tuple(r)[:4] for r in L.license_scan(df).collect()}
    assert plain == {(2, "line", 0, "all-rights-reserved")}
    more = {tuple(r)[:4] for r in L.license_scan(df, sentences=True).collect()} - plain
    assert more == {(1, "sentence", 1, "all-rights-reserved"), (3, "sentence", 5, "mit-notice")}


def test_whole_texts_and_own_templates(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(L.TEMPLATES.values())] + [(100, " " * 1_000_000), (101, "a" * 1_000_000), (102, "the license " * 100_000)]
    df = spark.createDataFrame([(d, t, "u", 0.0) for d, t in rows], SCHEMA)
    for small in (L.SMALL, 0):  # the index broadcast, and joined by a shuffle
        monkeypatch.setattr(L, "SMALL", small)
        got = L.license_scan(df).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    best = {r.doc_id: r.license for r in sorted(got, key=lambda r: r.dice)}
    assert [best[i] for i in range(len(L.TEMPLATES))] == list(L.TEMPLATES)
    one = L.license_scan(df, templates={"o'wn \\x": "mixed bag of own words here", "none": "word"}, threshold=0.9)
    assert one.count() == 0
