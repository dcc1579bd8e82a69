"""Shared helpers: checkpoints in the cluster's folder, byte-level word splitting, Arrow chunks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.operators.storage import checkpoint_root, cut

#: Bytes of text that one numpy pass handles at a time; longer texts are passes of their own.
CHUNK_BYTES = 1 << 20
#: The same for passes over shingles, which take some 100 bytes a byte.
PASS_BYTES = 1 << 18


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _lut(separators: str) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[[ord(c) for c in separators]] = False
    return lut


#: Bytes of words: all but white space, and letters a-z A-Z, digits and everything beyond ASCII.
SPACE_WORDS = _lut(" \t\n\v\f\r")
ALNUM_WORDS = _lut("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))

_TABLE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(19, n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, x, np.uint64)])) for x in (_P, _PINV)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts: byte ranges in ``buf``, the text each belongs to, and 64-bit hashes that ignore ASCII case.

    Equal words have equal hashes; different words differ but for a chance of about 2**-60 a pair.
    """

    def __init__(self, texts: list[bytes], lut: np.ndarray, hashes: bool = True):
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        inside = lut[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.text_ends = ends
        cuts = np.searchsorted(self.start, ends)
        self.counts = np.diff(cuts, prepend=0)
        self.first = cuts - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashes:
            p, q = _power(len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_TABLE[buf] * p[: len(buf)], out=total[1:])
            self._sums = total, q
            self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges."""
        total, q = self._sums
        return mix((total[end] - total[start]) * q[start]) | np.uint64(1)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-word shingles at each word, and which words start a whole one within their text."""
        h, size = self.hash, len(self.hash)
        if size < n:
            return np.zeros(size, np.uint64), np.zeros(size, bool)
        out = np.zeros(size, np.uint64)
        m = size - n + 1
        acc = np.zeros(m, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
        out[:m] = mix(acc)
        left = (self.first + self.counts)[self.doc] - np.arange(size)
        return out, left >= n


def rows(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, each of about ``limit`` bytes."""
    for batch in batches:
        texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in chunked(texts, limit):
            yield batch.slice(a, b - a), texts[a:b]
    batch = texts = None
    give_back()


def give_back() -> None:
    """Returns freed memory to the system; workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def tidy(df: DataFrame) -> DataFrame:
    """The table; Spark deletes shuffle files of what nothing refers to any more when its driver collects garbage, which a driver with free memory seldom does."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


#: Bits of a membership filter: 1 MiB to broadcast, whatever the number of ids.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, column: str, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """The table with a boolean column ``name`` that is true for all ids of the other table, and for few others while they are under some millions.

    It only saves shuffling rows that a join would drop, so its size is fixed: with more ids it passes more rows. The filter is joined, as a function
    in Python would be two more workers in each executor.
    """
    from pyspark.sql import functions as F

    spot = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("long"), F.lit(0))), F.lit(FILTER_BITS)) + 1
    bucket, bits = free(df, "__bucket", "__bits")
    found = ids.select(spot(id_col).alias("s")).groupBy(F.bitmap_bucket_number("s").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits))
    out = df.withColumn(bucket, F.bitmap_bucket_number(spot(column))).join(F.broadcast(found), bucket, "left")
    place = F.bitmap_bit_position(spot(column))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place.bitwiseAND(F.lit(7)) + 1).cast("int"))) > 0, F.lit(False))
    return out.withColumn(name, test).drop(bucket, bits)


def lean(df: DataFrame) -> DataFrame:
    """Smaller Arrow batches for tables of texts, where the session has Spark's default; workers hold a batch twice.

    The setting is read when a plan runs, so it stays for the session; a session that sets another value keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df
