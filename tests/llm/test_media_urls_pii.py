import hashlib
import random
import re
import zlib

import pytest

from aerograph.llm import media, pii, urls


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string, n_bytes long")


ROWS = [(1, "hello", "a", 1), (2, None, None, None), (2, None, None, None), (3, "", "b", 2), (None, "é" * 5000, "c", 3), (4, "x" * 300_000, "d", 4)]


def test_media_round_trip():
    for raw in (b"", b"a", bytes(range(256)) * 9, b"x" * 64 * 33, b"y" * 64 * 32):
        made = media.write_media(media.padded(raw))
        assert media.read_payload(made) == media.padded(raw)
        about = media.describe(made)
        assert about["codec"] == "raw" and about["error"] is None
        assert about["n_samples"] * 64 == len(media.padded(raw)) == about["duration"]
        payload = media.padded(raw)
        for i, k in enumerate(about["keyframes"]):
            assert made[k["offset"] : k["offset"] + k["length"]] == payload[i * 1024 : i * 1024 + 64]


def test_media_malformed():
    good = media.write_media(media.padded(b"abc"))
    assert media.describe(None)["error"] is None
    for bad in (b"", b"abc", good[:50], b"\0\0\0\4moov", media.box(b"moov", media.box(b"trak"))):
        assert media.describe(bad)["codec"] is None and media.describe(bad)["error"]


def test_media_digest(spark):
    got = {(r.doc_id, r.n_bytes): r for r in media.digest(docs(spark, ROWS)).collect()}
    assert media.digest(docs(spark, ROWS)).count() == len(ROWS)
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert media.digest(docs(spark, [])).count() == 0
    stored = media.store_payloads(docs(spark, ROWS), "doc_id", "text")
    again = media.media_columns(stored, "media").collect()
    assert {r.codec for r in again} == {"raw"}


def brute(text):
    """The contract's base patterns, run plainly."""

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if ok(kind, m[0])]
    return sorted(found, key=lambda x: (x[0], pii.ORDER[x[2]]))


def test_pii_equals_brute_force():
    rng, anchors = random.Random(5), pii.automaton()
    pieces = ["a@b.c", "@", ".", "x", "1", "22", "333", "+1", " ", "-", "(", ")", "4539578763621486", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "é", "%", "iban ", "://", "\n", "d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        base = [s for s in pii.spans_of(text, anchors) if pii.ORDER[s[2]] < 4]
        assert base == brute(text), text


def test_pii_adds_spans():
    anchors = pii.automaton()
    assert ("josé@exämple.de") in [t[a:b] for t in ["mail josé@exämple.de now"] for a, b, k in pii.spans_of(t, anchors) if k == "address"]
    text = 'token = "04dbebab91ab85687d33" and IBAN: DE89370400440532013000'
    assert [text[a:b] for a, b, k in pii.spans_of(text, anchors) if k == "account"] == ["04dbebab91ab85687d33", "DE89370400440532013000"]
    assert pii.spans_of("", anchors) == []
    long = "9" * 200_000 + "@" + "a" * 200_000
    assert pii.spans_of(long, anchors) == []


def test_pii_frame(spark):
    got = pii.find_spans(docs(spark, ROWS + [(9, "me@a.bc 10.0.0.1", "z", 0)]))
    assert got.count() == len(ROWS) + 1
    r = got.filter("doc_id = 9").first()
    assert (r.n_email, r.n_ip, r.spans) == (1, 1, "email:0:7,ip:8:16")
    assert r.base_sha256 == hashlib.sha256(b"email:0:7,ip:8:16").hexdigest()
    red = pii.redact(docs(spark, [(9, "me@a.bc 10.0.0.1", "z", 0), (None, None, None, None)]), length="n_bytes").collect()
    assert (red[0].text, red[0].n_bytes, red[0].extra) == ("[EMAIL] [IP]", 12, "z") and red[1].text is None


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1", "http://example.org/es/", "https://x.example.org/en/12?x", "https://notexample.org/es/", "http://org", "http://org/", "http://a.com/fr/x", "http://a.com/de/x#y", "ftp://com/de/", "http://spam-farm.net/x", "http://my-casino.de", "http://xcasinox.de", "http://a.net?ref=x", "http://a.org.evil.net/", "x://y://z.org/", "http://a.b\n.org/\n"]


def brute_url(u):
    if u is None or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(urls.LOWER)
    fits = [r for r in urls.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    bad = any(re.search(p.regex(), (u or "").translate(urls.LOWER), re.S) for p in urls.PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert urls.url_verdicts(df.limit(0)).count() == 0


def test_rule_tokens_are_whole():
    assert urls.Pattern("^a*b^c^").tokens() == {"c"}
    assert urls.Pattern("abc").tokens() == set()
    assert urls.HostRule("block", "example.org", "/en/1").tokens() == {"example", "org", "en"}
    filed, always = urls.index_rules([urls.HostRule("block", "example.org", "/es/"), urls.Pattern("free")], {"org": 5, "example": 5, "es": 2})
    assert filed == {"es": [0]} and always == [1]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_rules_beyond_a_pass(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MAX_RULES", most)
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}


def test_pii_spans_reach_the_real_end():
    anchors = pii.automaton()
    secret, local, user = "0f" * 64 + "a-b_c", "é" + "x" * 400, "u" * 300 + ":" + "p4" * 300
    assert pii.redacted(f"token = {secret} end", anchors) == "token = [ACCOUNT] end"
    assert pii.redacted(f"mail {local}@exämple.de now", anchors) == "mail [ADDRESS] now"
    assert pii.redacted(f"see https://{user}@host.org/x", anchors) == "see [ADDRESS]/x"
    assert pii.redacted(f"token={'a1' * 50}_token = 12345678", anchors) == "token=[ACCOUNT] = [ACCOUNT]"
    assert pii.redacted("token: my_tokenis 12345678", anchors) == "token: my_tokenis [ACCOUNT]"
    for x in ("token", "é@", "a://b"):  # linear in the text
        pii.spans_of(x * 100_000, anchors)


def test_accounts_are_checked_by_their_cue():
    anchors = pii.automaton()
    found = lambda text: [text[a:b] for a, b, k in pii.spans_of(text, anchors) if k == "account"]
    assert found("iban GB82 WEST 12345698765432") == [] and found("IBAN: GB82WEST12345698765432") == ["GB82WEST12345698765432"] and found("iban GB82WEST12345698765433") == []
    assert found("ssn 123-45-6789") == ["123-45-6789"] and found("ssn 000-45-6789") == [] and found("SSN: 987-65-4321") == []
    assert found("password: hunter2x") == ["hunter2x"] and found("password: hunters") == [] and found("secret=ab12cd34") == ["ab12cd34"]
    assert found("subtoken 12345678") == [] and found("my_token 12345678") == ["12345678"]  # a cue starts a word
    aws, git = "AKIA" + "IOSFODNN7EXAMPLE", "ghp_" + "a1B2" * 9
    assert found(f"x {aws}, {git}.") == [aws, git] and found(f"x{aws}") == [] and found(aws[:-1]) == []
    assert found(f"token = {git}") == [git] and found("eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20)
    for x in ("AKIA", "iban", "eyJa.", "sk-", "secret iban ", "password:"):  # linear in the text
        pii.spans_of(x * 100_000, anchors)


def test_fragments_and_several_tracks():
    import struct

    movie, fragment = media.write_media(bytes(range(64)) * 3), b""
    trak = movie[movie.index(b"trak") - 4 :]
    trak = trak[: struct.unpack(">I", trak[:4])[0]]
    empty = trak
    for kind in (b"stts", b"stsc", b"stsz", b"stss", b"stco"):  # a track whose tables are empty
        at = empty.index(kind) - 4
        size = struct.unpack(">I", empty[at : at + 4])[0]
        new = media.full(kind, bytes(8 if kind == b"stsz" else 4))
        grown = len(new) - size
        for name in (b"trak", b"mdia", b"minf", b"stbl"):
            i = empty.index(name) - 4
            empty = empty[:i] + struct.pack(">I", struct.unpack(">I", empty[i : i + 4])[0] + grown) + empty[i + 4 :]
        at = empty.index(kind) - 4
        empty = empty[:at] + new + empty[at + size :]
    moov = media.box(b"moov", empty, media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 1, 1, 10, 4, 0x10000))))
    payload = b"AAAABBBBCCCCDDDDEE"
    for n, (extra, first) in enumerate((((0x1 | 0x4), struct.pack(">I", 0)), ((0x1 | 0x200 | 0x400 | 0x800), b""))):
        rows = b"" if n == 0 else struct.pack(">IIi", 10, 0x10000, -3) + struct.pack(">IIi", 8, 0, 5)
        body = lambda offset: media.box(
            b"moof", media.full(b"mfhd", bytes(4)),
            media.box(b"traf", media.box(b"tfhd", struct.pack(">II", 0x20000, 1)), *([media.full(b"tfdt", struct.pack(">I", 100))] if n == 0 else []), media.box(b"trun", struct.pack(">IIi", extra, 3 if n == 0 else 2, offset) + first + rows)),
        )
        fragment += body(len(body(0)) + 8) + media.box(b"mdat", payload)
    data = media.box(b"ftyp", b"isom") + moov + fragment
    t = media.describe(data)["tracks"][0]
    at = [i for i in range(len(data)) if data.startswith(payload, i)]
    assert t["n_samples"] == 5 and t["keyframes"] == [{"offset": at[0], "length": 4, "time": 100}, {"offset": at[1] + 10, "length": 8, "time": 145}]
    assert media.read_payload(data) == payload[:12] + payload

    pair = media.box(b"ftyp", b"isom") + media.box(b"moov", empty, empty.replace(b"raw ", b"twos"))
    assert [x["codec"] for x in media.describe(pair)["tracks"]] == ["raw", "twos"] and media.describe(pair)["codec"] == "raw"
    cut_off = data[: len(data) - 4]
    assert media.describe(cut_off)["error"]


def test_key_frame_times():
    movie = media.write_media(bytes(64 * 40))
    keys = media.describe(movie)["tracks"][0]["keyframes"]
    assert [k["time"] for k in keys] == [0, 16 * 64, 32 * 64]


def test_long_inputs(spark):
    texts = [" " * 1_000_000, "a" * 1_000_000, "1" * 1_000_000, "@" * 300_000, "+1 " * 300_000, "1.2.3.4 " * 100_000, "token = " + "x1" * 50 + " end"]
    rows = docs(spark, [(i, t, "x", 0) for i, t in enumerate(texts)])
    assert [r.payload_bytes for r in media.digest(rows).orderBy("doc_id").collect()] == [-(-len(t) // 64) * 64 for t in texts]
    found = {r.doc_id: r for r in pii.find_spans(rows).collect()}
    assert [found[i].n_ip for i in range(7)] == [0, 0, 0, 0, 0, 100_000, 0] and found[6].spans == "account:8:108"
    long = ["http://a.org/" + "x/" * 200_000, "http://" + "a." * 200_000 + "com/de/", "casino/" * 100_000, "://" * 100_000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(long)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.url_verdicts(df).collect()}
    assert got == {0: ("org/", "allow"), 1: ("com/de/", "block"), 2: (None, "block"), 3: (None, "allow")}
