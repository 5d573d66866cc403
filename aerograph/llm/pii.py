"""PII by anchor expansion.

One Aho-Corasick pass finds at-signs, plus-signs, digits, schemes and identifier
cues; from each anchor a deterministic local parser expands to the boundaries and
validates. Every parser is linear in the text it covers, so very long runs cost no
backtracking. Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the method
adds ``address`` (mail addresses with letters outside ASCII, and user data in
URLs) and ``account``: identifiers after a cue such as "iban" or "token" that starts a word, checked by what the cue names
(check digits of an IBAN, ranges of a social security number, a mix of characters in a password, four digits in any other), and
keys that issuers start with a known prefix.

Null text counts as empty and gives no span. Rows are independent: repeated rows are
kept, ties by start are ordered by kind. Extra columns of the input are ignored by
``find_spans`` and carried by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import over_batches, table

KINDS = ("email", "ip", "card", "phone", "address", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Identifier cues, lower and title and upper case.
CUES = ("iban", "account", "acct", "ssn", "passport", "token", "api_key", "apikey", "password", "secret")

#: Prefixes of issued keys, and what follows them.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ASIA": r"[A-Z0-9]{16}(?![A-Za-z0-9])", "ghp_": r"[A-Za-z0-9_]{36,}+", "gho_": r"[A-Za-z0-9_]{36,}+", "github_pat_": r"[A-Za-z0-9_]{40,}+",
    "xoxb-": r"[A-Za-z0-9-]{20,}+", "xoxp-": r"[A-Za-z0-9-]{20,}+", "AIza": r"[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "sk-": r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+", "eyJ": r"[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*)(?:\.[^\W_][\w-]*)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
ACCOUNT = re.compile(r"[ \t]{0,3}(?:is|no\.?|number|#|:|=)?[ \t:=#\"']{0,4}([A-Za-z0-9](?:[A-Za-z0-9_-]|(?<=[0-9]) (?=[0-9]{2})){5,}+)")
USER_DATA = re.compile(r"[^\s/?#@]++@[^\s/?#@]+")
RUN = re.compile(r"[0-9]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
SSN = re.compile(r"([0-9]{3})-?([0-9]{2})-?([0-9]{4})")
PART = re.compile(r"[A-Za-z0-9_-]*+")
KEY = {prefix: re.compile(body) for prefix, body in KEYS.items()}


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for x in ("@", "+", "://", *"0123456789"):
        made.add_word(x, x)
    for prefix in KEYS:
        made.add_word(prefix, prefix)
    for cue in CUES:
        for x in {cue, cue.title(), cue.upper()}:
            made.add_word(x, f"cue {cue}")
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid_account(cue: str, value: str) -> bool:
    """Whether a value is of the kind that its cue names."""
    digits = sum(c in DIGITS for c in value)
    if cue == "iban":
        plain = value.replace(" ", "").replace("-", "").upper()
        return bool(IBAN.fullmatch(plain)) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if cue == "ssn":
        m = SSN.fullmatch(value.replace(" ", "-"))
        return bool(m) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    if cue == "password" and digits and any(c.isalpha() for c in value):
        return True
    return digits >= 4


def spans_of(text: str, anchors) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind; ends are exclusive code points."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    dead: dict[str, int] = {}  # by prefix
    mail_end = ip_end = card_end = phone_end = run_end = cue_end = plain_end = key_end = 0
    for last, what in anchors.iter(text):
        if what in DIGITS:
            if last < run_end:
                continue
            run_end = RUN.match(text, last).end()
            if last >= ip_end and (m := IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((last, ip_end, "ip"))
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                if card_end - last <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out.append((last, card_end, "card"))
        elif what == "@":
            start = last
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, last + 1) if start < last else None
            if m:
                mail_end = m.end()
                out.append((start, mail_end, "email"))
            wide = last
            while wide > 0 and (text[wide - 1] in LOCAL or text[wide - 1].isalnum()):
                wide -= 1
            w = WIDE_DOMAIN.match(text, last + 1) if wide < last else None
            if w and (not m or w.end() > m.end() or wide < start) and not text[wide : w.end()].isascii():
                out.append((wide, w.end(), "address"))
        elif what == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                end = m.end()
                while text[end - 1] not in DIGITS:
                    end -= 1
                if end >= last + 4:
                    phone_end = end
                    if 10 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                        out.append((last, end, "phone"))
        elif what == "://":
            if m := USER_DATA.match(text, last + 1):
                start = last - 2
                while start > 0 and text[start - 1].isalpha() and last - start < 16:
                    start -= 1
                out.append((start, m.end(), "address"))
        elif what in KEY:
            start = last + 1 - len(what)
            if start >= key_end and last >= dead.get(what, 0) and not text[start - 1 : start].isalnum():
                if m := KEY[what].match(text, last + 1):
                    key_end = m.end()
                    if start >= cue_end:
                        out.append((start, key_end, "account"))
                elif what in ("sk-", "eyJ"):
                    dead[what] = PART.match(text, last + 1).end()  # what starts inside this run has less of it
        elif last + 1 >= max(cue_end, key_end) and last + 7 >= plain_end and not text[last + 4 - len(what) : last + 5 - len(what)].isalnum() and (m := ACCOUNT.match(text, last + 1)):  # "number", the longest word before a value, has 6 letters
            if valid_account(what[4:], m[1]):
                cue_end = m.end()
                out.append((m.start(1), m.end(1), "account"))
            else:
                plain_end = m.end()  # cues inside this run start parts of it
    out.sort(key=lambda x: (x[0], ORDER[x[2]], x[1]))
    return out


def shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' digest, and all spans, for every row."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def step(batch: pa.RecordBatch) -> dict:
        anchors = automaton()
        out = {"doc_id": batch.column(0), "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS[:4]}
        for x in batch.column(1).to_pylist():
            found = spans_of(x or "", anchors)
            base = [s for s in found if ORDER[s[2]] < 4]
            for k in KINDS[:4]:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
            out["spans"].append(shown(found))
        return out

    return over_batches(df.select(df[key], df[text]), schema, step)


def redacted(text: str | None, anchors) -> str | None:
    """``text`` with every span (overlapping ones merged) replaced by its first kind in brackets."""
    found = spans_of(text or "", anchors)
    if not found:
        return text
    merged: list[list] = []
    for a, b, k in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, with personal data in ``text`` replaced and ``length`` (code points) made anew."""
    names = df.columns
    i, n = names.index(text), names.index(length) if length else None

    def step(batch: pa.RecordBatch) -> dict:
        anchors = automaton()
        made = [redacted(x, anchors) for x in batch.column(i).to_pylist()]
        out = {name: batch.column(k) for k, name in enumerate(names)} | {text: made}
        if n is not None:
            out[length] = [old if new is None else len(new) for new, old in zip(made, batch.column(n).to_pylist())]
        return out

    return over_batches(df, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), step)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))
