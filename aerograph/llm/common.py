"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerograph.scratch import Scratch, cut  # noqa: F401

#: ASCII white space, the complement of the contracts' word class ``[^\x20\x09-\x0D]``;
#: ``bytes.split()`` splits on exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a worker handles at once; Spark bounds the bytes of the batches it sends (64 MB).
ROWS, BYTES = 1000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A broadcast value, pickled with its classes, so that workers need no copy of this package; made once for a task."""

    def __init__(self, spark: SparkSession, value):
        self.handle, self.made = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self.made is None:
            self.made = pickle.loads(self.handle.value)
        return self.made


def release() -> None:
    """Give memory that is free back to the system; a worker that waits for its next task would else keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of ROWS rows and about BYTES bytes at most (or of one row), so that what a worker holds is bounded."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        each = min(ROWS, max(1, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
    release()


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def over_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Apply ``step`` (record batch to columns) to every Arrow batch of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = step(batch)
            arrays = [x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (murmur finaliser), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """Maps words to 64-bit hashes through a table that is emptied when it grows past ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.ids, self.values = limit, {}, np.zeros(1024, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        ids = self.ids
        new = [w for w in set(words) if w not in ids]
        if len(ids) + len(new) > self.limit and ids:
            ids.clear()
            new = list(set(words))
        if new:
            at = len(ids)
            while at + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values), np.uint64)])
            self.values[at : at + len(new)] = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))
            ids.update(zip(new, range(at, at + len(new))))
        return self.values[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words; fewer words make one run, none make none."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = mix64(words[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k])
    return out


def crc32_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus`` (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
