"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint has a row of Hamming distances to many reference fingerprints. References come in pairs that
differ in all 16 bits of one block and nowhere else; half the difference of their two distances tells how far a
fingerprint is from the reference within the block. By the triangle inequality, linked fingerprints differ in each
coordinate by at most the allowed distance of 2, and as two flipped bits touch two blocks of four at most, the coordinates of
two blocks are the same. So candidates meet by an equal join on the coordinates of two blocks, are discarded by
their largest coordinate difference, and survivors are verified by their own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import KEY, key_columns, keyed, map_texts, stored, text_bytes

BITS, BLOCKS, SHINGLE, SEED, DISTANCE = 64, 4, 3, 42, 2
#: Reference pairs for each block.
PAIRS = 8
#: Candidate groups up to this size are compared by shifting; larger ones row by row, the largest by flipping bits.
SMALL_GROUP, LARGE_GROUP = 32, 8192
#: Fingerprints of a candidate group above which it is dealt anew; links found before they are folded to a forest.
SPLIT_GROUP, HELD_LINKS = 1024, 1 << 20


def _references() -> np.ndarray:
    """Pairs of references, block after block; both of a pair are zero outside the block."""
    rng, width = np.random.default_rng(7), BITS // BLOCKS
    out = []
    for block in range(BLOCKS):
        mask = (1 << width) - 1
        for r in rng.integers(0, 1 << width, PAIRS):
            out += [int(r) << block * width, (int(r) ^ mask) << block * width]
    return np.array(out, np.uint64)


REFERENCES = _references()


def digest(hashes: np.ndarray) -> int:
    """64 bits: each set if set in over half of the hashes (unsigned 64-bit)."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes) -> int:
    """The digest of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())]
    return digest(np.array(hashes, "<u8"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(simhash, text_bytes(batch.column("_text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_id", *KEY)), pa.array(prints.view(np.int64))], ["_id", *KEY, "_fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, _h, _fp) of each row; see `keyed`."""
    rows = keyed(docs, id_col, text_col)
    return map_texts(rows, _mark, f"_id {rows.schema['_id'].dataType.simpleString()}, _k long, _h long, _fp long")


def candidate_keys(prints: DataFrame, split: int = SPLIT_GROUP) -> DataFrame:
    """Each distinct fingerprint under the pivot coordinates of any two blocks, `_pair` being their number.

    A group of over `split` fingerprints is dealt anew. Its members differ in the other two blocks, in two bits at most where they are linked:
    either one of these blocks is the same, or each has one bit flipped. So a member goes under its own value of the first, under
    the sixteen values one flip away, and under its own value of the second. What shares three blocks is at most 2**16 fingerprints.
    """
    distances = [F.bit_count(F.col("_fp").bitwiseXOR(F.lit(int(r.view(np.int64))))) for r in REFERENCES]
    inside = [a - b for a, b in zip(distances[::2], distances[1::2])]
    of_block = [inside[b * PAIRS : (b + 1) * PAIRS] for b in range(BLOCKS)]
    keys = [
        F.xxhash64(F.lit(n), *[c for b in kept for c in of_block[b]])
        for n, kept in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    ]
    pairs = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    numbered = F.posexplode(F.array(*keys)).alias("_pair", "_key")
    members = prints.select("_fp", numbered)
    large = stored(members.groupBy("_key").count().filter(F.col("count") > split).select("_key"), "simhash-large")
    if not large.limit(1).count():
        return members.select("_fp", "_key")
    width = BITS // BLOCKS

    def block(n: int) -> Column:
        return F.shiftrightunsigned("_fp", n * width).bitwiseAND(F.lit((1 << width) - 1))

    def own(which: int) -> Column:
        """The value of one of the blocks that the pair leaves out."""
        return reduce(
            lambda rest, n: F.when(F.col("_pair") == n, block([b for b in range(BLOCKS) if b not in pairs[n]][which])).otherwise(rest),
            range(len(pairs)),
            F.lit(None).cast("bigint"),
        )

    first, second = own(0), own(1)
    near = [first, *(first.bitwiseXOR(F.lit(1 << b)) for b in range(width))]
    dealt = [F.xxhash64("_key", F.lit(0), v) for v in near] + [F.xxhash64("_key", F.lit(1), second)]
    whole = members.join(large, "_key", "left_anti").select("_fp", "_key")
    return whole.unionByName(members.join(large, "_key", "left_semi").select("_fp", F.explode(F.array(*dealt)).alias("_key")))


def _pivots(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _near(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x, y) of places in a and b, those within the distance."""
    keep = np.abs(table[x] - table[y]).max(axis=1) <= DISTANCE if len(x) else np.zeros(0, bool)
    x, y = x[keep], y[keep]
    true = np.bitwise_count(a[x] ^ b[y]) <= DISTANCE
    return x[true], y[true]


def _large_group(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one sorted group."""
    n = len(prints)
    if n <= LARGE_GROUP:
        table = _pivots(prints)
        order = np.argsort(table[:, np.argmax(table.std(axis=0))], kind="stable")
        lead = table[order, np.argmax(table.std(axis=0))]
        last = np.searchsorted(lead, lead + DISTANCE, side="right")
        for at in range(0, n, 64):
            rows = np.arange(at, min(at + 64, n))
            spread = last[rows] - rows - 1
            x = np.repeat(rows, spread)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(spread) - spread, spread)
            yield _near(prints, prints, order[x], order[y], table)
        return
    moving = int(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = [1 << b for b in range(BITS) if moving >> b & 1]
    for flips in [*((b,) for b in bits), *combinations(bits, 2)]:
        other = prints ^ np.uint64(sum(flips))
        at = np.minimum(np.searchsorted(prints, other), n - 1)
        x = np.flatnonzero((prints[at] == other) & (prints < other))
        yield x, at[x]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place that each place is linked with, over any number of links."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and fingerprint. A group's links leave as a forest, never as all its pairs."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        fresh = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        start = np.flatnonzero(fresh)
        label, xs, ys, held = np.arange(len(prints)), [], [], 0

        def add(x: np.ndarray, y: np.ndarray, whole: bool = False) -> None:
            """Links are held until there are many, or `whole`; then only the forest of all so far is kept."""
            nonlocal label, xs, ys, held
            xs.append(x)
            ys.append(y)
            held += len(x)
            if whole or held > HELD_LINKS:
                label = _forest(len(prints), label[np.concatenate(xs)], label[np.concatenate(ys)])[label]
                xs, ys, held = [], [], 0

        many = (size[group] > 1) & (size[group] <= SMALL_GROUP)
        at = np.flatnonzero(many)
        keys_s, prints_s = keys[at], prints[at]
        table = _pivots(prints_s)
        for shift in range(1, int(size[size <= SMALL_GROUP].max(initial=1))):
            x = np.flatnonzero(keys_s[shift:] == keys_s[:-shift])
            if not len(x):
                break
            x, y = _near(prints_s, prints_s, x, x + shift, table)
            add(at[x], at[y])
        for g in np.flatnonzero(size > SMALL_GROUP):
            for x, y in _large_group(prints[start[g] : start[g] + size[g]]):
                add(start[g] + x, start[g] + y)
        add(np.zeros(0, np.int64), np.zeros(0, np.int64), whole=True)
        child = np.flatnonzero(label != np.arange(len(prints)))
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[child].view(np.int64)), pa.array(prints[label[child]].view(np.int64))], ["_a", "_b"]
        )

    held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        held_k = np.r_[held_k, np.asarray(batch.column("_key"))]
        held_p = np.r_[held_p, np.asarray(batch.column("_fp")).view(np.uint64)]
        if not len(held_k):
            continue
        done = np.searchsorted(held_k, held_k[-1])
        if done:
            yield links(held_k[:done], np.ascontiguousarray(held_p[:done]))
            held_k, held_p = held_k[done:], held_p[done:]
    if len(held_k):
        yield links(held_k, held_p)


def similar_fingerprints(prints: DataFrame, split: int = SPLIT_GROUP) -> DataFrame:
    """Links (_a, _b) between distinct fingerprints whose components are those of all links within the distance."""
    return (
        candidate_keys(prints, split)
        .repartition("_key")
        .sortWithinPartitions("_key", F.col("_fp").bitwiseXOR(F.lit(-(1 << 63))))
        .mapInArrow(_link, "_a long, _b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node: large stars and small stars in turn until nothing moves."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        # Stored, it stands behind an exchange of its own, so that a node with very many links can be split.
        least = stored(both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m")), "links-least")
        joined = both.join(least, "_a")
        if small:  # pairs point from larger to smaller: all smaller neighbours and the node itself go below the least
            moved = joined.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(
                least.select("_a", F.col("_m").alias("_b"))
            )
        else:
            moved = joined.filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        return moved.filter("_a <> _b").distinct()

    def digest(pairs: DataFrame):
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        return tuple(row)

    pairs = stored(edges.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "links")
    before = digest(pairs)
    while before[0]:
        pairs = stored(star(star(pairs, small=False), small=True), "links")
        now = digest(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("_a").alias("node"), F.col("_b").alias("root"))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Marks of all rows; for each fingerprint its root and the smallest id of its component."""
    marks = stored(fingerprints(docs, id_col, text_col), "simhash-marks")
    classes = stored(marks.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-classes")
    roots = components(similar_fingerprints(classes.select("_fp")))
    named = classes.join(roots, classes["_fp"] == roots["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root")
    )
    smallest = stored(named.groupBy("_root").agg(F.min("_least").alias("component_id")), "simhash-smallest")
    return marks, named.join(smallest, "_root").select("_fp", "_root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, fingerprint (16 hex digits), component id: the smallest id that links reach, its own included.

    Null and empty texts have fingerprint zero, which links like any other. Null ids are passed over when the
    smallest is taken. Repeated rows are in one component. An empty table gives an empty result; other columns are
    not read.
    """
    marks, by_print = _groups(docs, id_col, text_col)
    return marks.join(by_print, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (null last), one of several rows alike."""
    marks, by_print = _groups(docs, id_col, text_col)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *KEY, "_n"))
    stays = (
        marks.groupBy("_id", *KEY, "_fp")
        .agg(F.count("*").alias("_n"))
        .join(by_print, "_fp")
        .groupBy("_root")
        .agg(best.alias("_best"))
        .select("_best._k", "_best._h", "_best._n")
    )
    stays = stored(stays, "simhash-stays")
    rows = docs.select(F.struct("*").alias("_row"), *key_columns(id_col, text_col))
    kept = rows.join(stays, KEY)
    if stays.filter("_n > 1").limit(1).count():  # some rows are alike in id and text
        kept = kept.filter("_n = 1").unionByName(kept.filter("_n > 1").dropDuplicates(KEY))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
