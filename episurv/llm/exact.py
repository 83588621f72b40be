"""Exact duplicates: counting quotient filters find repeated fingerprints, bytes decide.

Each partition of fingerprints becomes a counting quotient filter. A fingerprint's high bits are its quotient, the
low bits its remainder; remainders of a quotient stand sorted in one run, each with a counter. Such filters merge without
loss: runs of the same quotient are merged by remainder and their counters added. What is counted once in the
merged filter is unique, and its row is done. Rows of repeated fingerprints are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import SPACES, stored

#: High bits of a quotient that name a segment: the unit in which filters are sent and merged.
SEGMENT_BITS = 12
#: Bits of the remainder; the other bits of a 64-bit fingerprint are the quotient.
REMAINDER_BITS = 40


class CountingQuotientFilter:
    """Quotients in order, the length of each one's run, remainders sorted within runs, a counter for each."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        if counts is None:
            counts = np.ones(len(fingerprints), np.int64)
        order = np.argsort(fingerprints, kind="stable")
        values = fingerprints[order]
        at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
        quotients, runs = np.unique(values[at] >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients, runs, values[at] & np.uint64((1 << REMAINDER_BITS) - 1), total)

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients, self.runs) << np.uint64(REMAINDER_BITS) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def segments(self) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The parts of the filter by the high bits of the quotient."""
        names = (self.quotients >> np.uint64(64 - REMAINDER_BITS - SEGMENT_BITS)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(names)) + 1, len(names)] if len(names) else [0]
        ends = np.r_[0, np.cumsum(self.runs)]
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = ends[a], ends[b]
            yield int(names[a]), CountingQuotientFilter(
                self.quotients[a:b], self.runs[a:b], self.remainders[lo:hi], self.counts[lo:hi]
            )

    def packed(self) -> dict[str, bytes]:
        """Remainders without their unused high bytes; the rest as it is."""
        width = REMAINDER_BITS // 8
        return {
            "quotients": self.quotients.astype("<u4").tobytes(),
            "runs": self.runs.astype("<u4").tobytes(),
            "remainders": self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
            "counts": self.counts.astype("<i8").tobytes(),
        }

    @classmethod
    def unpacked(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        width = REMAINDER_BITS // 8
        wide = np.zeros((len(remainders) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(remainders, np.uint8).reshape(-1, width)
        return cls(
            np.frombuffer(quotients, "<u4").astype(np.uint64),
            np.frombuffer(runs, "<u4").astype(np.int64),
            wide.reshape(-1).view("<u8").astype(np.uint64),
            np.frombuffer(counts, "<i8"),
        )


FILTER_SCHEMA = "segment int, quotients binary, runs binary, remainders binary, counts binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
    whole = CountingQuotientFilter.of(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    rows = [{"segment": name, **part.packed()} for name, part in whole.segments()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema(
            [("segment", pa.int32()), *((n, pa.binary()) for n in ("quotients", "runs", "remainders", "counts"))]
        ))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment; one merged segment is in memory at a time."""

    def repeated(filters: list[CountingQuotientFilter]) -> pa.RecordBatch:
        whole = CountingQuotientFilter.merged(filters)
        many = whole.counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(whole.fingerprints()[many].view(np.int64)), pa.array(whole.counts[many])], ["fingerprint", "n"]
        )

    name, filters = None, []
    for batch in batches:
        for row in batch.to_pylist():
            segment = row.pop("segment")
            if segment != name and filters:
                yield repeated(filters)
                filters = []
            name = segment
            filters.append(CountingQuotientFilter.unpacked(**row))
            if len(filters) == 64:  # many small parts: fold them
                filters = [CountingQuotientFilter.merged(filters)]
    if filters:
        yield repeated(filters)


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, n) of each value of the only column, a long, that occurs n > 1 times."""
    return (
        fingerprints.mapInArrow(_build, FILTER_SCHEMA)
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge, "fingerprint long, n long")
    )


def normalised(text: str):
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, the id that stays of its group, the group's size, whether this row stays, the digest.

    Texts are equal when the same after white space is deleted; null counts as empty. The row with most code points
    in the original text stays, then the smallest id (null last); of rows alike in both, exactly one. An empty table gives
    an empty result. Other columns are not read, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("_chars"),
        normalised(text_col).alias("_norm"),
    )
    digests = stored(
        rows.select(
            F.monotonically_increasing_id().alias("_row"),
            "_id",
            "_chars",
            F.xxhash64("_norm").alias("_fp"),
            F.sha2("_norm", 256).alias("_sha"),
        ),
        "exact-digests",
    )
    repeated = stored(
        repeated_fingerprints(digests.select("_fp")).select(F.col("fingerprint").alias("_fp"), F.col("n").alias("_copies")),
        "exact-repeated",
    )
    # The filters route: a row whose fingerprint they counted once is alone, only the others are looked at further.
    marked = stored(digests.join(repeated, "_fp", "left"), "exact-marked")
    routed = marked.filter("_copies IS NOT NULL")
    # Byte verification: candidates are grouped by the very bytes, copies of a task being merged before they move.
    verified = (
        docs.select(normalised(text_col).alias("_norm"))
        .withColumn("_fp", F.xxhash64("_norm"))
        .join(repeated, "_fp", "left_semi")
        .groupBy("_norm")
        .count()
        .filter("count > 1")
        .select(F.sha2("_norm", 256).alias("_sha"))
    )
    order = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("none"), "_id", "_row")
    # Grouped before the join: a group's rows of one task are one row when they move.
    groups = routed.groupBy("_sha").agg(F.min(order).alias("_best"), F.count("*").alias("_size")).filter("_size > 1")
    stays = groups.join(stored(verified, "exact-verified"), "_sha", "left_semi")
    # Stored, it stands behind an exchange of its own, so that hot keys of the other side can be split.
    stays = stored(stays, "exact-stays")
    many = routed.join(stays, "_sha", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_best._row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    alone = marked.filter("_copies IS NULL").select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return alone.unionByName(many)
