"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of documents. Its words become symbols; words that no phrase has, and neighbours that no phrase has as
neighbours, part the text, and only parts long enough for a phrase are indexed. The index is the Burrows-Wheeler
transform in a wavelet tree, with suffix positions sampled. All phrases are searched backwards at once; rows found are
walked to a sampled position; their word spans are merged for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import ALNUM_TABLE, KEY, alnum_words, key_columns, map_texts, others, slices, stored, text_bytes

PHRASE = 10
#: Bytes of benchmark text searched at once. A larger benchmark is searched block after block.
BLOCK_BYTES = 4 << 20
#: Every so many positions of a part, the suffix position is kept.
SAMPLE = 8


@dataclass
class Phrases:
    """Distinct phrases as rows of word numbers from 1 (0 pads at the end), and the items of each."""

    words: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_of: np.ndarray  # item numbers, phrase by phrase
    item_from: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], length: int) -> Phrases:
        words: dict[bytes, int] = {}
        rows, owners = [], []
        for n, (_, text) in enumerate(items):
            ids = np.array([words.setdefault(w, len(words) + 1) for w in alnum_words(text)], np.int32)
            if not len(ids):
                continue
            padded = np.r_[ids, np.zeros(max(0, length - len(ids)), np.int32)]
            windows = np.lib.stride_tricks.sliding_window_view(padded, length)
            rows.append(windows)
            owners.append(np.full(len(windows), n))
        if not rows:
            none = np.zeros(0, np.int64)
            return cls(words, np.zeros((0, length), np.int32), none, [], none, np.zeros(1, np.int64))
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        names = sorted({name for name, _ in items if name is not None})
        place = {name: i for i, name in enumerate(names)}
        number = np.array([place.get(name, -1) for name, _ in items])  # an item without id has no number
        pairs = np.unique(np.stack([which.reshape(-1), number[np.concatenate(owners)]]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        starts = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
        return cls(words, distinct, (distinct > 0).sum(axis=1), names, pairs[1], starts)


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes sorted, by doubling; zeros part the text and go by their place, so no comparison passes one."""
    n = len(symbols)
    parts = symbols == 0
    rank = np.where(parts, np.cumsum(parts) - 1, symbols.astype(np.int64) + int(parts.sum()))
    span = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        span *= 2


class FMIndex:
    """Backward search and location over symbols from 1 in parts that zeros bound on both sides."""

    def __init__(self, symbols: np.ndarray):
        order = _suffix_order(symbols)
        last = symbols[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(symbols))]  # rows that start with smaller symbols
        part = np.flatnonzero(symbols == 0)
        inside = order - part[np.searchsorted(part, order, side="right") - 1] - 1
        sampled = (inside < 0) | (inside % SAMPLE == 0)  # the start of each part is, so no walk crosses a bound
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        # The wavelet tree, level by level: ones before each place, and how many zeros the level has.
        self.depth = max(1, int(symbols.max()).bit_length())
        self.ones, self.zeros, self.start = [], [], np.zeros(int(symbols.max()) + 1, np.int64)
        now = last
        every = np.arange(len(self.start))
        for level in range(self.depth - 1, -1, -1):
            bits = (now >> level) & 1
            ones = np.r_[0, np.cumsum(bits)].astype(np.int32)
            zeros = len(now) - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            before = ones[self.start]
            self.start = np.where((every >> level) & 1, zeros + before, self.start - before)
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        for i, level in enumerate(range(self.depth - 1, -1, -1)):
            before = self.ones[i][place]
            place = np.where((symbol >> level) & 1, self.zeros[i] + before, place - before)
        return place - self.start[symbol]

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        symbol, place = np.zeros_like(row), row
        for i in range(self.depth):
            before = self.ones[i][place]
            bit = self.ones[i][place + 1] - before
            symbol = symbol << 1 | bit
            place = np.where(bit, self.zeros[i] + before, place - before)
        return self.first[symbol] + place - self.start[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases found, with their rows [low, high)."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.sampled))
        for step in range(int(lengths.max(initial=0))):
            at = lengths[live] - 1 - step
            go = at >= 0
            symbol = phrases[live[go], at[go]]
            low[go] = self.first[symbol] + self.rank(symbol, low[go])
            high[go] = self.first[symbol] + self.rank(symbol, high[go])
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_rows, at = np.zeros(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(open_rows):
            known = self.sampled[open_rows]
            out[at[known]] = self.samples[self.sample_rank[open_rows[known]]] + steps
            at = at[~known]
            open_rows = self.step_back(open_rows[~known])
            steps += 1
        return out


def _occurrences(ids: np.ndarray, phrases: Phrases, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place of its first word in ids) of every occurrence; ids has 0 for foreign words and between texts."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(phrases.rows):
        return none, none
    known = ids > 0
    pairs = ids[:-1].astype(np.int64) * (len(phrases.words) + 1) + ids[1:]
    both = np.flatnonzero(known[:-1] & known[1:])
    linked = np.zeros(len(ids), bool)  # this word and the next are neighbours in some phrase
    if len(links):
        at = np.minimum(np.searchsorted(links, pairs[both]), len(links) - 1)
        linked[both[links[at] == pairs[both]]] = True
    starts = np.flatnonzero(known & ~np.r_[False, linked[:-1]])
    ends = np.flatnonzero(known & ~linked) + 1
    long = ends - starts >= phrases.lengths.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none
    sizes = ends - starts
    at = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(np.r_[0, sizes[:-1]]), sizes)
    local, symbols = np.unique(ids[at], return_inverse=True)
    # 0 part 0 part 0 ... 0
    place = np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes) + 1
    text = np.zeros(len(at) + len(sizes) + 1, np.int64)
    text[place] = symbols + 1
    origin = np.zeros(len(text), np.int64)
    origin[place] = at
    renamed = np.zeros(len(phrases.words) + 1, np.int64)
    renamed[local] = np.arange(1, len(local) + 1)
    wanted = renamed[phrases.rows]
    here = np.flatnonzero(((wanted > 0) | (phrases.rows == 0)).all(axis=1))
    index = FMIndex(text)
    found, low, high = index.search(wanted[here], phrases.lengths[here])
    count = high - low
    rows = np.arange(int(count.sum())) + np.repeat(low - np.cumsum(np.r_[0, count[:-1]]), count) if len(count) else none
    return here[np.repeat(found, count)], origin[index.locate(rows)]


def _merged_spans(hit: np.ndarray) -> list[dict]:
    turns = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1))]


def _without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    blank = np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) == 0x20
    turns = np.diff(np.r_[1, blank.astype(np.int8), 1])
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    out, at = [], 0
    for span in spans:
        out.append(text[at : starts[span["start"]]])
        at = ends[span["end"] - 1]
    return b"".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search_block(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """Adds this block's spans and items to columns _spans and _items; counts words into _words."""
    names = rows.columns
    text, spans, items = names.index("_text"), names.index("_spans"), names.index("_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases  # of at most BLOCK_BYTES of text, it travels with the function
        get = known.words.get
        left, right = known.rows[:, :-1].astype(np.int64), known.rows[:, 1:]
        codes = left * (len(known.words) + 1) + right
        links = np.unique(codes[(left > 0) & (right > 0)])
        for batch in batches:
            for shard in slices(batch, "_text"):
                parts = [[get(w, 0) for w in alnum_words(t)] for t in text_bytes(shard.column(text))]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                first = np.r_[0, np.cumsum(sizes + 1)]  # one 0 after each text
                ids = np.zeros(int(first[-1]), np.int32)
                for part, a in zip(parts, first):
                    ids[a : a + len(part)] = part
                phrase, place = _occurrences(ids, known, links)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + known.lengths[phrase], -1)
                hit = np.cumsum(change[:-1]) > 0
                doc = np.searchsorted(first, place, side="right") - 1
                pairs = np.unique(np.stack([doc, phrase]), axis=1)
                new_spans = shard.column(spans).to_pylist()
                new_items = shard.column(items).to_pylist()
                cuts = np.searchsorted(pairs[0], np.arange(len(parts) + 1))
                for d in np.unique(doc):
                    mine = np.zeros(sizes[d], bool)
                    mine |= hit[first[d] : first[d] + sizes[d]]
                    for span in new_spans[d]:
                        mine[span["start"] : span["end"]] = True
                    new_spans[d] = _merged_spans(mine)
                    got = {
                        known.items[i]
                        for p in pairs[1, cuts[d] : cuts[d + 1]]
                        for i in known.item_of[known.item_from[p] : known.item_from[p + 1]]
                    }
                    new_items[d] = sorted(got.union(new_items[d]))
                columns = list(shard.columns)
                columns[spans] = pa.array(new_spans, SPANS)
                columns[items] = pa.array(new_items, pa.list_(pa.string()))
                columns[names.index("_words")] = pa.array(sizes)
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(rows, run, rows.schema)


def _pieces(text: bytes, length: int, most: int) -> Iterator[bytes]:
    """Parts of the text, of about `most` bytes, that together have its phrases."""
    if len(text) <= most:
        yield text
        return
    turns = np.diff(np.r_[1, (np.frombuffer(text.translate(ALNUM_TABLE), np.uint8) == 0x20).astype(np.int8), 1])
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    a, b = 0, 0
    while b < len(starts):
        b = min(len(starts), max(a + length, int(np.searchsorted(ends, starts[a] + most, side="right"))))
        yield text[starts[a] : ends[b - 1]]
        a = b - length + 1


def _blocks(items: DataFrame, length: int, block_bytes: int) -> list[DataFrame]:
    """The benchmark's (_item, _t) in tables of at most block_bytes each, unless one phrase alone is longer."""
    items = items.filter(F.octet_length("_t") > 0)
    size = F.octet_length("_t") + F.coalesce(F.octet_length("_item"), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        return [items]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                texts = [p.decode() for p in _pieces(text, length, block_bytes // 16)]
                columns = [pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_item", "_t"])

    pieces = stored(items.mapInArrow(cut, items.schema).distinct(), "benchmark-pieces")
    total, largest = pieces.agg(F.sum(size), F.max(size)).first()
    count = 2 * -(-(total or 0) // block_bytes)
    place = F.xxhash64("_item", "_t")

    def fullest() -> int:
        return pieces.groupBy(F.pmod(place, F.lit(count))).agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0]

    while count and fullest() > max(block_bytes, largest):
        count *= 2
    return [pieces.filter(F.pmod(place, F.lit(count)) == n) for n in range(count)] or [pieces]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    length: int = PHRASE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every row of `docs`: _row (a struct of its other columns), _text, _words, _spans (of words, merged),
    _items (as strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A phrase is `length` consecutive words of
    an item, or all words of a shorter one. Null texts have no words; an item without id marks words but is not
    listed; items with one id are one. An empty benchmark finds nothing. The benchmark is measured first and
    searched in blocks that are small enough to send to every task; items longer than a block are cut into pieces that
    overlap by a word less than a phrase.
    """
    blocks = _blocks(benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text).alias("_t")), length, block_bytes)
    none = [F.array().cast("array<struct<start:int,end:int>>").alias("_spans"), F.array().cast("array<string>").alias("_items")]
    words = F.lit(0).cast("long").alias("_words")
    found = []
    for n, block in enumerate(blocks[:-1]):
        keyed_rows = docs.select(F.col(text_col).alias("_text"), *key_columns(text_col, text_col), words, *none)
        hits = _search_block(keyed_rows, _phrases(block, length)).filter(F.size("_spans") > 0)
        # Of a text that is hit only its key, spans and items are written; the texts stay where they are.
        found.append(stored(hits.select(*KEY, F.lit(n).alias("_block"), "_spans", "_items"), "contamination"))
    rows = docs.select(others(docs, text_col).alias("_row"), F.col(text_col).alias("_text"), words, *none)
    if found:
        named = stored(_merged_hits(reduce(DataFrame.unionByName, found)), "contamination-merged")
        keys = docs.select(
            others(docs, text_col).alias("_row"), F.col(text_col).alias("_text"), words, *key_columns(text_col, text_col)
        )
        known = [F.coalesce(c, empty).alias(c) for c, empty in zip(("_spans", "_items"), none)]
        rows = keys.join(named, KEY, "left").select("_row", "_text", "_words", *known)
    return _search_block(rows, _phrases(blocks[-1], length))


def _phrases(block: DataFrame, length: int) -> Phrases:
    return Phrases.of([(r["_item"], r["_t"].encode()) for r in block.collect()], length)


def _merged_hits(hits: DataFrame) -> DataFrame:
    """One row a text from the rows of several blocks; of copies of a text, one counts."""
    grouped = hits.dropDuplicates([*KEY, "_block"]).groupBy(*KEY).agg(
        F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column("_spans").to_pylist():
                hit = np.zeros(max(s["end"] for s in spans), bool)
                for span in spans:
                    hit[span["start"] : span["end"]] = True
                merged.append(_merged_spans(hit))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEY), pa.array(merged, SPANS), batch.column("_items")], [*KEY, "_spans", "_items"]
            )

    return grouped.mapInArrow(merge, grouped.schema)


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """For each row: id, words, words hit, spans, items with occurring phrases (ids as sorted strings)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find_contamination(rows, benchmark, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("_row.id").alias(id_col),
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("_spans").alias("spans"),
        F.col("_items").alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows as of `find_contamination`, _text without its hit spans, from the first to the last byte of their words.

    Texts without a hit stay as they are. A document that had words and has none left is dropped.
    """
    found = find_contamination(docs, benchmark, text_col, **options)
    names = found.columns
    text, spans = names.index("_text"), names.index("_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, columns = batch.column(spans).to_pylist(), list(batch.columns)
            if any(where):
                texts = columns[text].to_pylist()
                for i, spans_of in enumerate(where):
                    if spans_of:
                        texts[i] = _without(texts[i].encode(), spans_of).decode()
                columns[text] = pa.array(texts, columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, names)  # also without a hit: all batches have one schema

    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return map_texts(found.filter((F.size("_spans") == 0) | (hit < F.col("_words"))), cut, found.schema)
