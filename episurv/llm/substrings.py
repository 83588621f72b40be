"""Repeated word sequences by level-wise doubling.

Windows of a quarter of the length come first, then of half, then whole ones (9, 18 and 35 words). A window that stands alone
at one length cannot be repeated at twice that length, so only repeated ones are extended. At the first two lengths it is
enough to look, for each whole window, at the one inside it with the smallest hash: equal windows choose the same. Whole
windows that chose the same inner ones meet in one group, each as eight bytes, and those met twice are repeated.
Groups of frequent inner windows are salted, and what a salted part leaves open is settled by a second count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import KEY, WordHashes, keyed, mixed, slices, stored, text_bytes, window_minima

WINDOW = 35
#: Bytes of text hashed at once; arrays take some fifty bytes for each.
SLICE = 1 << 20
#: A group of an inner window is split into parts of at most this share of a task's rows.
HOT_SHARE = 1 / 8


def _halves(window: int) -> tuple[int, int]:
    half = -(-window // 2)
    return -(-half // 2), half


class _Shard:
    """Word hashes of several documents and the places where a whole window fits."""

    def __init__(self, hashes: WordHashes, texts: list[bytes], window: int):
        self.words, self.first, *_ = hashes.words(texts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        n = max(0, len(self.words) - window + 1)
        self.fits = self.doc[:n] == self.doc[window - 1 :] if n else np.zeros(0, bool)

    def inner(self, hashes: WordHashes, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of `length`; for each whole window the place of the one it chooses."""
        values = hashes.windows(self.words, length)
        return values, window_minima(values, window - length + 1)


def _first_level(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashes, (quarter, _) = WordHashes(), _halves(window)
    for batch in batches:
        for part in slices(batch, "_text", SLICE):
            shard = _Shard(hashes, text_bytes(part.column("_text")), window)
            values, chosen = shard.inner(hashes, quarter, window)
            at = np.unique(chosen[shard.fits])
            doc = shard.doc[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c).take(pa.array(doc)) for c in KEY),
                    pa.array((at - shard.first[doc]).astype(np.int32)),
                    pa.array(values[at].view(np.int64)),
                ],
                [*KEY, "_at", "_hash"],
            )


EXTENDED = "_k long, _h long, _group long, _salts int, _salt int, _start int, _windows array<long>"


def _extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Whole windows around surviving inner ones, those with the same inner windows in one row."""
    hashes, (quarter, half) = WordHashes(), _halves(window)
    for batch in batches:
        for part in slices(batch, "_text", SLICE):
            shard = _Shard(hashes, text_bytes(part.column("_text")), window)
            salts = np.zeros(len(shard.words) + 1, np.int32)  # of surviving inner windows, by place
            found = part.column("_found")
            sizes = np.asarray(pa.compute.list_value_length(found))
            flat = found.flatten()
            places = np.asarray(flat.field("at")) + np.repeat(shard.first[: len(sizes)], sizes)
            np.maximum.at(salts, places, np.asarray(flat.field("salts")))
            values1, chosen1 = shard.inner(hashes, quarter, window)
            values2, chosen2 = shard.inner(hashes, half, window)
            whole = hashes.windows(shard.words, window, 2)
            at = np.flatnonzero(shard.fits & (salts[chosen1] > 0) if len(chosen1) else np.zeros(0, bool))
            if not len(at):
                continue
            a, b = chosen1[at], chosen2[at]
            fresh = np.r_[True, (np.diff(at) != 1) | (np.diff(a) != 0) | (np.diff(b) != 0)]
            head = np.flatnonzero(fresh)
            doc = shard.doc[at[head]]
            group = mixed(values2[b[head]] + mixed(values1[a[head]]))
            parts = salts[a[head]]
            keys = [np.asarray(part.column(c))[doc] for c in KEY]
            start = (at[head] - shard.first[doc]).astype(np.int32)
            salt = (mixed(keys[0].view(np.uint64) + start.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, keys),
                    pa.array(group.view(np.int64)),
                    pa.array(parts),
                    pa.array(salt),
                    pa.array(start),
                    pa.ListArray.from_arrays(
                        pa.array(np.r_[head, len(at)].astype(np.int32)), pa.array(whole[at].view(np.int64))
                    ),
                ],
                [*KEY, "_group", "_salts", "_salt", "_start", "_windows"],
            )


SETTLED = "_k long, _h long, _group long, _at array<int>, _open array<struct<at:int,window:long,known:boolean>>"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and salt. _at: windows met twice; _open, of salted groups only: one of each such
    window, marked known, and those met once."""
    open_type = pa.struct([("at", pa.int32()), ("window", pa.int64()), ("known", pa.bool_())])

    def settled(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()

        def column(name: str) -> pa.Array:
            return rows.column(name).chunk(0)

        group = np.asarray(column("_group"))
        salt = np.asarray(column("_salt"))
        lists = column("_windows")
        sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
        windows = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(group)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.asarray(column("_start"))[row]
        order = np.lexsort((windows, salt[row], group[row]))
        g, s, w = group[row][order], salt[row][order], windows[order]
        same = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (w[1:] == w[:-1])
        twice_sorted = np.r_[False, same] | np.r_[same, False]
        head_sorted = ~np.r_[False, same]
        twice, head = np.zeros(len(row), bool), np.zeros(len(row), bool)
        twice[order], head[order] = twice_sorted, head_sorted
        left = head & (np.asarray(column("_salts"))[row] > 1)
        keep = np.flatnonzero(np.bincount(row[twice | left], minlength=len(group)))

        def lists_of(mask: np.ndarray, values: pa.Array) -> pa.ListArray:
            offsets = np.r_[0, np.cumsum(np.bincount(row[mask], minlength=len(group))[keep])]
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

        opened = pa.StructArray.from_arrays(
            [pa.array(at[left].astype(np.int32)), pa.array(windows[left]), pa.array(twice[left])], fields=list(open_type)
        )
        return pa.RecordBatch.from_arrays(
            [
                *(column(c).take(pa.array(keep)) for c in (*KEY, "_group")),
                lists_of(twice, pa.array(at[twice].astype(np.int32))),
                lists_of(left, opened),
            ],
            [*KEY, "_group", "_at", "_open"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.asarray(batch.column("_group"))
        cut = int(np.flatnonzero(names != names[-1])[-1]) + 1 if (names != names[-1]).any() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield settled(pa.Table.from_batches(held))
            held = []
        elif held and held[-1].column("_group")[-1].as_py() != names[-1]:
            yield settled(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield settled(pa.Table.from_batches(held))


def repeated_windows(rows: DataFrame, window: int = WINDOW, hot: int | None = None) -> DataFrame:
    """(_k, _h, _at): per document the places of windows whose words also start elsewhere. `hot` is the number of occurrences of an inner
    window above which its group is split, by default HOT_SHARE of the occurrences that a shuffle partition has on average."""
    first = rows.mapInArrow(lambda b: _first_level(b, window), "_k long, _h long, _at int, _hash long")
    # Stored, it stands behind an exchange of its own, so that hot keys of the other side can be split.
    repeated = stored(first.groupBy("_hash").count().filter("count > 1"), "substring-repeated")
    if hot is None:
        total = repeated.agg(F.sum("count")).first()[0] or 0
        hot = max(1, int(total * HOT_SHARE / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col("count") / hot).cast("int")
    found = stored(
        first.join(repeated, "_hash")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct(F.col("_at").alias("at"), salts.alias("salts"))).alias("_found")),
        "substring-candidates",
    )
    extended = rows.join(found, KEY).select(*KEY, "_text", "_found").mapInArrow(lambda b: _extend(b, window), EXTENDED)
    settled = extended.repartition("_group", "_salt").sortWithinPartitions("_group", "_salt").mapInArrow(_settle, SETTLED)
    hits = settled.filter(F.size("_at") > 0).select(*KEY, "_at")
    if found.agg(F.max(F.array_max("_found.salts"))).first()[0] not in (None, 1):  # some group was split
        opened = (
            settled.select(*KEY, "_group", F.explode("_open").alias("_o"))
            .select(*KEY, "_group", F.col("_o.at").alias("_at"), F.col("_o.window").alias("_w"), F.col("_o.known").alias("_known"))
        )
        again = opened.groupBy("_group", "_w").count().filter("count > 1").select("_group", "_w")
        late = opened.filter("NOT _known").join(again, ["_group", "_w"])
        hits = hits.unionByName(late.select(*KEY, F.array("_at").alias("_at")))
    return hits.groupBy(*KEY).agg(F.flatten(F.collect_list("_at")).alias("_at"))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int | None = None
) -> DataFrame:
    """For each row: id, words, words removed, the kept words joined by one blank.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` consecutive words of
    its document covers it whose sequence also starts elsewhere, in this or another document; windows are judged on the
    input. So all copies go. Null texts have no words; repeated rows are copies of each other; an empty table gives
    an empty result; other columns are not read. Sequences are compared by 128 bits of hashes.
    """
    rows = keyed(docs, id_col, text_col)
    marked = rows.join(repeated_windows(rows, window, hot), KEY, "left")
    kind = rows.schema["_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                totals, gone, kept = [], [], []
                for text, at in zip(text_bytes(part.column("_text")), part.column("_at")):
                    words = text.split()
                    change = np.zeros(len(words) + 1, np.int64)
                    if at.is_valid:
                        starts = np.unique(np.asarray(at.values))
                        change[starts] += 1
                        change[starts + window] -= 1
                    out = np.cumsum(change[:-1]) > 0
                    totals.append(len(words))
                    gone.append(int(out.sum()))
                    if gone[-1]:
                        words = [words[i] for i in np.flatnonzero(~out).tolist()]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["_id", "n_words", "n_removed", "kept"],
                )

    out = marked.mapInArrow(remove, f"_id {kind}, n_words long, n_removed long, kept string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept")
