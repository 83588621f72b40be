"""Alignment of two tokenizers by galloping intersection of their token ends.

Both tokenizers cut the same bytes. The ends of the tokens are two ascending lists; the shorter one drives an exponential
and then a binary search into the longer, from where the last search ended. Ends that both have cut a document into groups: the
differences of their ranks in each list say how many tokens of either side a group spans. The last tokens of a group end together and
are linked; links are counted over the corpus by their pair of ids.

A link's tokens end at one byte, so the bytes of one are a suffix of those of the other: the pairs that can occur are bounded by
the two vocabularies, whatever the corpus (`pair_bound`). That is what allows the counts to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import map_texts, slices, stored
from episurv.llm.packing import Encoder

#: Neighbours of the shorter list that one lane searches in turn; lanes run side by side.
LANE = 64
#: Bytes of text aligned at a time (or one document).
PART_BYTES = 1 << 20
#: Bytes of a pair in a broadcast table, about; tables that may be larger than the second are joined by Spark's own choice.
PAIR_BYTES, BROADCAST_BYTES = 64, 64 << 20


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """The byte-level tokenizer: ids of texts, bytes of ids. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoding = Encoder(path).encoding
        self.bytes_of = [b""] * self.encoding.n_vocab
        for token in self.encoding.token_byte_values():
            self.bytes_of[self.encoding.encode_single_token(token)] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(text) for text in texts]


class PieceTokens:
    """The piece tokenizer, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            whole = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_of.append(whole)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two ascending lists. Lanes of LANE neighbours of the shorter list run side by side, each
    searching on from where its last search ended."""
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(0, n, LANE)
    place = np.zeros(n, np.int64)
    at = np.searchsorted(long, short[starts])
    for step in range(min(LANE, n)):
        mine = starts + step
        if mine[-1] >= n:
            mine = mine[:-1]
        target = short[mine]
        low = at[: len(mine)].copy()
        # Exponential: long[low - 1] < target always; jumps double while they land on less than the target.
        jump = np.ones(len(mine), np.int64)
        going = np.flatnonzero((low < m) & (long[np.minimum(low, m - 1)] < target))
        high = low.copy()
        while len(going):
            low[going] += 1
            ahead = low[going] + jump[going] - 1
            less = (ahead < m) & (long[np.minimum(ahead, m - 1)] < target[going])
            high[going] = np.minimum(ahead, m)
            low[going[less]] = ahead[less]
            going = going[less]
            jump[going] *= 2
        # Binary, between the last jump that fell short and the first that did not.
        going = np.flatnonzero(low < high)
        while len(going):
            middle = (low[going] + high[going]) >> 1
            less = long[middle] < target[going]
            low[going[less]] = middle[less] + 1
            high[going[~less]] = middle[~less]
            going = going[low[going] < high[going]]
        place[mine] = low
        at[: len(mine)] = low
    same = np.flatnonzero((place < m) & (long[np.minimum(place, m - 1)] == short))
    return same, place[same]


def common_ends(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends they share. The lists hold one document after the other, from a_first and b_first on
    (one more at the end); of each document the shorter list drives."""
    a_size, b_size = np.diff(a_first), np.diff(b_first)
    found = []
    for a_drives in (True, False):
        chosen = (a_size <= b_size) == a_drives
        x = np.flatnonzero(np.repeat(chosen, a_size))
        y = np.flatnonzero(np.repeat(chosen, b_size))
        if a_drives:
            i, j = gallop(a[x], b[y])
        else:
            j, i = gallop(b[y], a[x])
        found.append((x[i], y[j]))
    i, j = (np.concatenate(parts) for parts in zip(*found))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _joined(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, words: tuple) -> np.ndarray:
    """Texts of all tokens as they follow each other when groups are written `a,a|b,b;`."""
    a_more, a_end, b_more, b_end = words
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[a_last] = True
    ends_b[b_last] = True
    group_a = np.cumsum(ends_a) - ends_a
    group_b = np.cumsum(ends_b) - ends_b
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.r_[0, b_last + 1][group_a]] = np.where(ends_a, a_end[a], a_more[a])
    out[np.arange(len(b)) + (a_last + 1)[group_b]] = np.where(ends_b, b_end[b], b_more[b])
    return out


def align(
    docs: DataFrame, file_a: str | None = None, file_b: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For each row: id, n_a and n_b (tokens), groups (`a1,a2|b1;a3|b2,b3`: ids in order), links (array of pairs of ids as
    one number, a * size of the second vocabulary + b, one for each common end).

    Texts that are null or empty, or whose tokens joined differ from a space and the text on either side, have no tokens: zeros, an
    empty string, an empty array. Rows are aligned one by one: repeated rows alike, an empty table gives an empty result. Other
    columns are not read.
    """
    named = default_files()
    file_a, file_b = file_a or named[0], file_b or named[1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = ByteTokens(file_a), PieceTokens(file_b)
        size_a, size_b = (np.array([len(t) for t in s.bytes_of], np.int64) for s in (side_a, side_b))
        words = tuple(
            np.array([f"{i}{mark}" for i in range(len(s.bytes_of))], object) for s, marks in ((side_a, ",|"), (side_b, ",;")) for mark in marks
        )
        a_of, b_of = side_a.bytes_of.__getitem__, side_b.bytes_of.__getitem__
        for batch in batches:
            for part in slices(batch, "_text", PART_BYTES):
                texts = part.column("_text").to_pylist()
                solid = [n for n, t in enumerate(texts) if t]
                coded = zip(solid, side_a.encode([" " + texts[n] for n in solid]), side_b.encode([texts[n] for n in solid]))
                whole, a_lists, b_lists = [], [], []
                for n, a, b in coded:
                    want = b" " + texts[n].encode()
                    if b"".join(map(a_of, a)) == want and b"".join(map(b_of, b)) == want:
                        whole.append(n)
                        a_lists.append(np.array(a, np.int64))
                        b_lists.append(np.array(b, np.int64))
                rows_n = np.array(whole, np.int64)
                a_first, b_first = (np.cumsum([0, *map(len, lists)]) for lists in (a_lists, b_lists))
                a, b = (np.concatenate([np.zeros(0, np.int64), *lists]) for lists in (a_lists, b_lists))
                # Both sides hold the same bytes, so ends counted over the whole part agree.
                a_last, b_last = common_ends(np.cumsum(size_a[a]), np.cumsum(size_b[b]), a_first, b_first)
                text = _joined(a, b, a_last, b_last, words).tolist()
                groups = [""] * len(texts)
                for n, lo, hi in zip(whole, (a_first + b_first)[:-1].tolist(), (a_first + b_first)[1:].tolist()):
                    groups[n] = "".join(text[lo:hi])[:-1]
                counts = np.zeros((3, len(texts)), np.int64)
                counts[0, rows_n] = np.diff(a_first)
                counts[1, rows_n] = np.diff(b_first)
                counts[2, rows_n] = np.diff(np.searchsorted(a_last, a_first))
                links = pa.array(a[a_last] * len(size_b) + b[b_last])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(counts[0]),
                        pa.array(counts[1]),
                        pa.array(groups, pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[2])], pa.int32()), links),
                    ],
                    [id_col, "n_a", "n_b", "groups", "links"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return map_texts(rows, run, f"`{id_col}` {kind}, n_a long, n_b long, groups string, links array<long>")


def pair_bound(file_a: str | None = None, file_b: str | None = None) -> int:
    """How many pairs of ids can be linked at all: one token's bytes end with the other's."""
    named = default_files()
    a, b = ByteTokens(file_a or named[0]).bytes_of, PieceTokens(file_b or named[1]).bytes_of
    a_of, b_of = {}, {}
    for tokens, of in ((a, a_of), (b, b_of)):
        for token in filter(None, tokens):
            of[token] = of.get(token, 0) + 1
    longer_a = sum(n * b_of.get(t[k:], 0) for t, n in a_of.items() for k in range(len(t)))
    longer_b = sum(n * a_of.get(t[k:], 0) for t, n in b_of.items() for k in range(1, len(t)))
    return longer_a + longer_b


def size_of_second(file_b: str | None = None) -> int:
    return len(PieceTokens(file_b or default_files()[1]).bytes_of)


def link_counts(links: DataFrame, second: int) -> DataFrame:
    """(pair, count, best) from rows with an array `links`: how often each pair is linked in the corpus, and whether no other
    partner of its second id is linked more often."""
    counts = stored(
        links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "link-counts"
    )
    highest = counts.groupBy(F.pmod("pair", F.lit(second)).alias("_b")).agg(F.max("count").alias("_most"))
    joined = counts.withColumn("_b", F.pmod("pair", F.lit(second))).join(highest, "_b")
    return joined.select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def link_scores(links: DataFrame, key: str, file_a: str | None = None, file_b: str | None = None) -> DataFrame:
    """For each value of the unique column `key` that has links: n_links, n_best, count_sum. `links` is a stored table."""
    counts = stored(link_counts(links, size_of_second(file_b)), "link-best")
    if pair_bound(file_a, file_b) * PAIR_BYTES <= BROADCAST_BYTES:
        counts = counts.hint("broadcast")  # its size is bounded by the vocabularies, whatever the corpus
    each = links.select(key, F.explode("links").alias("pair")).join(counts, "pair")
    return each.groupBy(key).agg(
        F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum")
    )
