"""Media columns: ISO base media files, written, walked and indexed without decoding their payload.

``media_columns`` reads any ISO media file (nested boxes, 32- and 64-bit sizes, sample tables and movie fragments)
and stores of every track its codec, timescale, duration, and the byte ranges and presentation times of key frames; the first track's stand in columns of their own.
``store_payloads`` wraps bytes losslessly as an 8-bit PCM track and reads them back
through the sample tables. Null or malformed files give null fields and an
``error``; empty payloads become one block of zeros; rows are independent, so
ties, repeated rows and extra columns change nothing. A task holds a few copies of one text at a time, of any length that fits a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blobs, over_batches, table

BLOCK = 64  # bytes of a sample
PER_CHUNK = 32  # samples of a chunk
KEY_EVERY = 16  # a sync sample every so many samples
RATE = 8000  # PCM samples a second
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))

TRACK = "codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,length:long,time:long>>"
MEDIA_SCHEMA = f"codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, tracks array<struct<{TRACK}>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def padded(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of the block."""
    return payload + bytes(-len(payload) % BLOCK or (0 if payload else BLOCK))


def write_media(payload: bytes) -> bytes:
    """An ISO media file whose one track holds ``payload`` (whole blocks) as 8-bit mono PCM."""
    n = len(payload) // BLOCK
    chunks = -(-n // PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ftyp = box(b"ftyp", b"isom\0\0\2\0isommp41")
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != PER_CHUNK)
    entry = box(b"raw ", bytes(6) + struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = first + np.arange(chunks, dtype=np.uint64) * np.uint64(BLOCK * PER_CHUNK)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", BLOCK, n)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        wave = n * BLOCK  # the track's duration is held in 32 bits, as version 0 boxes do
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, wave & 0xFFFFFFFF, 0x55C4, 0)),
            full(b"hdlr", b"\0\0\0\0soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, wave & 0xFFFFFFFF), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), unity, bytes(8))
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, wave & 0xFFFFFFFF, 0x10000, 256), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    data = box(b"mdat", payload)
    head = len(data) - len(payload)
    first = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(first) + data


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of every box below; raises ValueError on sizes that do not fit."""
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


def numbers(view: memoryview, at: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(view[at:], kind, n).astype(np.int64)


def spread(view: memoryview, a: int, signed: bool) -> np.ndarray:
    """One value per sample of a table of (count, value) pairs."""
    pairs = numbers(view, a + 8, ">u4", 2 * struct.unpack_from(">I", view, a + 4)[0]).reshape(-1, 2)
    values = pairs[:, 1].astype(np.uint32).astype(np.int32).astype(np.int64) if signed else pairs[:, 1]
    return np.repeat(values, pairs[:, 0])


def table_samples(t: dict) -> dict[str, np.ndarray]:
    """offsets, sizes, sync (whether a key frame), times (decode) and shifts (to presentation) of a track's sample tables."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["runs"]
    ends = np.append(runs[1:, 0] - 1, len(chunks))
    counts = np.repeat(runs[:, 1], ends - runs[:, 0] + 1)
    if len(counts) != len(chunks) or counts.sum() != len(sizes):
        raise ValueError("sample tables disagree")
    n, before = len(sizes), np.cumsum(sizes) - sizes
    firsts = np.cumsum(counts) - counts
    chunk = np.repeat(np.arange(len(chunks)), counts)
    offsets = chunks[chunk] + before - before[firsts[chunk]] if n else before
    sync = np.ones(n, bool)
    if "sync" in t:
        if len(t["sync"]) and not 0 <= t["sync"].min() <= t["sync"].max() < n:
            raise ValueError("samples lie outside the file")
        sync[:] = False
        sync[t["sync"]] = True
    deltas, shifts = t.get("deltas", np.zeros(n, np.int64)), t.get("shifts", np.zeros(n, np.int64))
    if len(deltas) != n or len(shifts) != n:
        raise ValueError("sample tables disagree")
    return {"offsets": offsets, "sizes": sizes, "sync": sync, "times": np.cumsum(deltas) - deltas, "shifts": shifts, "end": np.array([deltas.sum()])}


def fragment_run(view: memoryview, a: int, head: dict, start: int) -> dict[str, np.ndarray]:
    """The samples of one run of a movie fragment; ``start``: where its data starts if the run does not say."""
    flags, n = struct.unpack_from(">I", view, a)[0] & 0xFFFFFF, struct.unpack_from(">I", view, a + 4)[0]
    at = a + 8
    if flags & 1:
        start, at = head["base"] + struct.unpack_from(">i", view, at)[0], at + 4
    first, at = (struct.unpack_from(">I", view, at)[0], at + 4) if flags & 4 else (None, at)
    given = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    rows = numbers(view, at, ">u4", n * len(given)).reshape(n, len(given))
    column = lambda name, other: rows[:, given.index(name)] if name in given else np.full(n, other, np.int64)
    sizes, marks, deltas = column("size", head["size"]), column("flags", head["flags"]).copy(), column("duration", head["duration"])
    if first is not None and n and "flags" not in given:
        marks[0] = first
    shifts = column("shift", 0).astype(np.uint32).astype(np.int32).astype(np.int64)
    return {"offsets": start + np.cumsum(sizes) - sizes, "sizes": sizes, "sync": marks & 0x10000 == 0, "times": head["time"] + np.cumsum(deltas) - deltas, "shifts": shifts, "end": np.array([head["time"] + deltas.sum()])}


def fragment_head(view: memoryview, a: int, moof: int, extends: dict[int, dict]) -> dict:
    """track, base (of data offsets), and defaults of samples, of one track in a movie fragment."""
    flags, track = struct.unpack_from(">II", view, a)
    out, at = {"track": track, "base": moof, "time": 0} | extends.get(track, {"duration": 0, "size": 0, "flags": 0}), a + 8
    for bit, name, kind in ((1, "base", ">Q"), (2, None, ">I"), (8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
        if flags & bit:
            value = struct.unpack_from(kind, view, at)[0]
            at += struct.calcsize(kind)
            out |= {name: value} if name else {}
    return out


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, timescale, duration, and arrays of its samples: offsets, sizes, times, shifts, and the numbers of key frames (sync)."""
    view, out, extends, runs = memoryview(data), [], {}, {}
    moof, head, data_end = 0, {}, 0
    for path, a, b in walk(view, 0, len(data)):
        kind = path[-1]
        if kind == b"moof":
            moof = data_end = a - 8
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", view, a + 4)
            extends[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd":
            head = fragment_head(view, a, moof, extends)
            head["time"] = int(runs[head["track"]][-1]["end"][0]) if head["track"] in runs else None
            data_end = head["base"]
        elif kind == b"tfdt":
            head["time"] = struct.unpack_from(">Q" if view[a] else ">I", view, a + 4)[0]
        elif kind == b"trun":
            head["time"] = 0 if head["time"] is None else head["time"]
            some = fragment_run(view, a, head, data_end)
            runs.setdefault(head["track"], []).append(some)
            head["time"], data_end = int(some["end"][0]), int(some["offsets"][-1] + some["sizes"][-1]) if len(some["sizes"]) else data_end
        elif kind == b"trak":
            out.append({"codec": None, "timescale": None, "duration": None, "track": None})
        if not out or len(path) < 2:
            continue
        t = out[-1]
        if kind == b"tkhd":
            t["track"] = struct.unpack_from(">I", view, a + (12 if view[a] == 0 else 20))[0]
        elif kind == b"mdhd":
            at = ">II" if view[a] == 0 else ">IQ"
            t["timescale"], t["duration"] = struct.unpack_from(at, view, a + (12 if view[a] == 0 else 20))
        elif kind == b"stsd":
            t["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1").strip()
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", view, a + 4)
            t["sizes"] = np.full(n, each, np.int64) if each else numbers(view, a + 12, ">u4", n)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = numbers(view, a + 8, ">u4" if kind == b"stco" else ">u8", struct.unpack_from(">I", view, a + 4)[0])
        elif kind == b"stsc":
            n = struct.unpack_from(">I", view, a + 4)[0]
            t["runs"] = numbers(view, a + 8, ">u4", 3 * n).reshape(n, 3)
        elif kind == b"stss":
            t["sync"] = numbers(view, a + 8, ">u4", struct.unpack_from(">I", view, a + 4)[0]) - 1
        elif kind == b"stts":
            t["deltas"] = spread(view, a, False)
        elif kind == b"ctts":
            t["shifts"] = spread(view, a, True)
    for t in out:
        if not {"sizes", "chunks", "runs"} <= t.keys():
            raise ValueError("sample tables are missing")
        parts = [table_samples(t), *runs.get(t["track"], [])]
        t |= {k: np.concatenate([x[k] for x in parts]) for k in ("offsets", "sizes", "times", "shifts", "sync")}
        t["sync"] = np.flatnonzero(t["sync"])
        if len(parts) > 1:
            t["duration"] = t["duration"] or int(parts[-1]["end"][0])
        if len(t["sizes"]) and ((t["offsets"] + t["sizes"]).max() > len(data) or t["offsets"].min() < 0):
            raise ValueError("samples lie outside the file")
    return out


def describe(data: bytes | None) -> dict:
    """The media columns of one file; payload bytes are never touched."""
    none = {"codec": None, "timescale": None, "duration": None, "n_samples": None, "keyframes": None, "tracks": None, "error": None}
    if data is None:
        return none
    try:
        found = tracks(data)
        if not found:
            raise ValueError("no track")
    except (ValueError, struct.error) as e:
        return none | {"error": str(e)}
    made = []
    for t in found:
        keys = zip(*(t[x][t["sync"]].tolist() for x in ("offsets", "sizes", "times", "shifts")))
        made.append({"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["sizes"]), "keyframes": [{"offset": o, "length": n, "time": at + shift} for o, n, at, shift in keys]})
    first = made[0] | {"keyframes": [{"offset": k["offset"], "length": k["length"]} for k in made[0]["keyframes"]]}
    return first | {"tracks": made, "error": None}


def read_payload(data: bytes) -> bytes:
    """The first track's samples, joined; runs of adjacent samples are copied at once."""
    t = tracks(data)[0]
    offsets, sizes = t["offsets"], t["sizes"]
    breaks = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    stops = np.append(breaks[1:], len(offsets)) - 1
    return b"".join(data[offsets[i] : offsets[j] + sizes[j]] for i, j in zip(breaks, stops))


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """``content`` (binary) described: one row per input row, in a result of its own that keeps ``content``."""

    def step(batch: pa.RecordBatch) -> dict:
        files = batch.column(0).to_pylist()
        rows = [describe(x) for x in files]
        return {"content": batch.column(0)} | {k: [r[k] for r in rows] for k in rows[0]} if rows else {"content": batch.column(0), **{k: [] for k in describe(None)}}

    return over_batches(df.select(df[content]), f"content binary, {MEDIA_SCHEMA}", step)


def store_payloads(df: DataFrame, key: str, text: str) -> DataFrame:
    """Store each text's padded UTF-8 bytes as a media file and read it back: key, n_bytes, media, payload, features."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>"

    def step(batch: pa.RecordBatch) -> dict:
        texts = blobs(batch.column(1))
        media = [write_media(padded(x)) for x in texts]
        rows = [describe(x) for x in media]
        return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in texts], "media": media, "payload": [read_payload(x) for x in media]} | {
            k: [r[k] for r in rows] for k in ("codec", "timescale", "duration", "n_samples", "keyframes")
        }

    return over_batches(df.select(df[key], df[text]), schema, step)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's digest of what ``store_payloads`` makes, without moving files out of the workers."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(raw: bytes) -> tuple:
        media = write_media(padded(raw))
        back, about = read_payload(media), describe(media)
        samples = np.frombuffer(back, np.uint8)
        keys = about["keyframes"]
        feature = ";".join(
            str(x)
            for x in (
                about["codec"], about["timescale"], about["duration"], about["n_samples"], len(keys), keys[0]["offset"], keys[-1]["offset"],
                int(samples.sum(dtype=np.int64)), int(samples.max()), int(np.count_nonzero(samples)),
            )
        )
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def step(batch: pa.RecordBatch) -> dict:
        rows = [one(x) for x in blobs(batch.column(1))]
        return {"doc_id": batch.column(0)} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    return over_batches(df.select(df[key], df[text]), schema, step)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
