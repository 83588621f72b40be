"""Helpers that the operators share: tables, scratch tables, words and rolling hashes of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episurv.session import scratch_path

#: White space as bytes.split() sees it, which is `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"

#: A-Z to a-z; every ASCII byte that is neither letter nor digit to a blank; all others as they are.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)

_BLANK_TABLE = bytes(0x20 if chr(b) in SPACES else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and merged at every size: it grows with the corpus, so a plan that broadcasts it on little
    data tells nothing of the plan on much."""
    return df.hint("merge")


#: Bytes of an Arrow batch of texts. JVM and Python each hold a batch on its way in and one on its way out, for every task.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow` in batches of about BATCH_BYTES or one row; a bound that the session's owner set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(run, schema)


KEY = ["_k", "_h"]


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two hashes that name a document between two scans; rows alike in id and text share them."""
    return [F.xxhash64(id_col, text_col).alias("_k"), F.xxhash64(text_col).alias("_h")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *key_columns(id_col, text_col))


def others(docs: DataFrame, text_col: str) -> Column:
    """A struct of all columns but the text, so that a text goes through Python once."""
    names = [c for c in docs.columns if c != text_col]
    return F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).cast("boolean").alias("_none")])


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(ALNUM_TABLE).split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows, each of about `most` bytes of text or of one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


# ---- rolling hashes, modulo 2**64 -------------------------------------------------------------

_RNG = np.random.default_rng(20240501)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd bases, so that they have inverses; one for bytes, two for words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**i and base**-i modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 12)
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (self.base, inverse)
            )
        return self.up[: n + 1], self.down[: n + 1]


class WordHashes:
    """Words of several texts, hashed without a Python object for each word."""

    def __init__(self):
        self.powers = [Powers(b) for b in BASES]

    def _rolling(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        up, down = self.powers[which].upto(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Hashes of all words `[^\\x20\\x09-\\x0D]+`, first word of each text (one more at the end), the joined
        texts, and where each word starts and ends in them."""
        joined = b" ".join([*texts, b""]).translate(_BLANK_TABLE)
        data = np.frombuffer(joined, np.uint8)
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = data != 0x20
        turns = np.diff(solid)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
        return self._rolling(_BYTE_VALUES[data], starts, ends, 0), first, joined, starts, ends

    def windows(self, words: np.ndarray, length: int, which: int = 1) -> np.ndarray:
        """A hash for each window of `length` words; text bounds are the caller's business."""
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return self._rolling(words, at, at + length, which)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbours, where its smallest value is (the leftmost of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(len(values) - 1).bit_length())
    place = np.arange(len(values), dtype=np.uint64)
    low = (values >> np.uint64(bits) << np.uint64(bits)) | place
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:n], low[width - span : width - span + n])
    return (low[:n] & np.uint64((1 << bits) - 1)).astype(np.int64)
