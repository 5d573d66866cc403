"""Token counts by offset-mapped attribution.

A document is its fields, joined by a separator, and is encoded whole and once. Byte-level tokens map
to character spans through their byte lengths. Sections are the fields, or the lines
of the fields; a separator or line break belongs to the section before it. The
sections part the document, so the interval join of sorted token spans with sorted section
bounds is a merge. A token that crosses a boundary goes to one section, by ``rule``:

* ``most``  - the section that holds most of its bytes (ties: the first of them),
* ``first`` - the section in which it starts,
* ``last``  - the section in which it ends.

Every document gives at least one section (null fields count as empty); sections without
tokens are kept with 0. Rows are independent, so repeated rows give repeated
results; the result holds only the named columns. White-space runs of over ``LONG`` characters are parted by the
pattern's own rule (the last character goes with what follows) before it runs, since its matcher cannot hold runs of
any length; a pattern of one's own must part them so too. The vocabulary file is a parameter: the driver
reads it and ships it to the workers.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blobs, over_batches, table

RULES = ("most", "first", "last")
#: The public pattern by which this family of vocabularies parts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The matcher's white space.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG = 10_000
SCHEMA = "doc_id long, section int, field int, start long, end long, n_tokens long, n_crossing long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = re.compile(f"{BLANK}{{{LONG},}}")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def tokens(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self.runs.finditer(text) if len(text) >= LONG else ():
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.lengths[np.asarray(self.tokens(text), np.int64)])


def sections_of(fields: list[bytes], separator: bytes, lines: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(document, byte bounds of its sections: n + 1 ascending offsets, field number of each section)."""
    document = separator.join(fields)
    starts = np.cumsum([0, *(len(f) + len(separator) for f in fields[:-1])])
    if not lines:
        return document, np.append(starts, len(document)), np.arange(len(fields))
    breaks = np.flatnonzero(np.frombuffer(document, np.uint8) == 10) + 1
    bounds = np.union1d(starts, breaks[breaks < len(document)])
    return document, np.append(bounds, max(len(document), bounds[-1])), np.searchsorted(starts, bounds, "right") - 1


def allot(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary)."""
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(bounds[1:-1], starts, "right")
    last = np.searchsorted(bounds[1:-1], ends - 1, "right")
    cross = first != last
    if rule == "first" or not cross.any():
        return first, cross
    if rule == "last":
        return last, cross
    own = first.copy()
    for k in np.flatnonzero(cross):
        inner = np.arange(first[k], last[k] + 1)
        held = np.minimum(bounds[inner + 1], ends[k]) - np.maximum(bounds[inner], starts[k])
        own[k] = inner[held.argmax()]
    return own, cross


def char_offsets(document: bytes, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets that lie between characters."""
    if document.isascii():
        return at
    heads = np.cumsum((np.frombuffer(document, np.uint8) & 0xC0) != 0x80)
    return np.append(0, heads)[at]


def token_counts(df: DataFrame, key: str, fields: list[str], *, lines: bool = False, separator: str = "\n", rule: str = "most", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, field, start, end (character offsets in the joined document), n_tokens, n_crossing of every section.

    ``n_crossing`` counts those of the section's tokens that reach into another section.
    """
    if rule not in RULES or not fields:
        raise ValueError(f"rule must be one of {RULES}, and there must be fields")
    # A vocabulary file is a parameter of fixed size.
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    glue = separator.encode()

    def step(batch: pa.RecordBatch, made: list = []) -> dict:  # noqa: B006  one encoder for a task's batches
        if not made:
            made.append(Encoder(shared.value, pattern))
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        columns = [blobs(batch.column(1 + i)) for i in range(len(fields))]
        for row in range(batch.num_rows):
            document, bounds, owner = sections_of([c[row] for c in columns], glue, lines)
            n = len(owner)
            if document:
                own, cross = allot(made[0].ends(document.decode()), bounds, rule)
                counts, crossing = np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n)
            else:
                counts = crossing = np.zeros(n, np.int64)
            at = char_offsets(document, bounds)
            for x, y in zip(out, (np.arange(n), owner, at[:-1], at[1:], counts, crossing)):
                x.append(y)
        sizes = [len(x) for x in out[0]]
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
        return {"doc_id": ids} | {k: np.concatenate(v) if v else [] for k, v in zip(("section", "field", "start", "end", "n_tokens", "n_crossing"), out)}

    return over_batches(df.select(df[key], *(df[f] for f in fields)), SCHEMA, step)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", ["text"], lines=True)
