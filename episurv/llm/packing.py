"""Packing of token ids into fixed windows by the sum-of-squares rule, online.

A task takes its documents in order. Whole windows are cut off a document's front; the rest goes to the fill level whose
choice makes the sum of squared counts of partially filled windows smallest. The counts are an array by level. Windows that
are still partly filled at the end are poured together, cut where one is full; what then remains is cut at powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episurv.llm.common import map_texts

WINDOW = 1024
END = 0
#: Partly filled windows that a task may have before it pours them together.
OPEN_WINDOWS = 4096


class Encoder:
    """Token ids of texts by the vocabulary of a byte-level BPE file.

    The file is one of the `tokenizers` library, whose own encoder needs over three times the CPU seconds allowed. The
    same merges run in `tiktoken`, whose ids are the same (the tests compare them). With `added`, the file's added tokens
    have their own ids wherever their string stands in a text, as the file's encoder has it when loaded; without, such a
    string is ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        own = {t["content"]: t["id"] for t in content.get("added_tokens") or ()}
        # Byte-level files write each byte as a visible character: printable ones as they are, others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        for token in own:  # no merges make them
            ranks.pop(token.encode(), None)
        self.encoding = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own if added else {}
        )

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text, END last."""
        ids = self.encoding.encode(text, allowed_special="all")
        ids.append(END)
        return np.array(ids, "<u4")


class SumOfSquares:
    """Open windows by fill level. Pieces are (document, start, ids, tokens of the document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # counts[0] and counts[window] stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple) -> list[tuple] | None:
        """The window's pieces if this one fills it."""
        size, counts, full = len(piece[2]), self.counts, self.window
        # From level h to h + size: the sum gains 2 counts[h + size] + 1 and loses 2 counts[h] - 1.
        gain = 2 * counts[size:] + 1
        gain[-1] = 0
        gain[1:] -= 2 * counts[1 : full - size + 1] - 1
        gain[1:][counts[1 : full - size + 1] == 0] = np.iinfo(np.int64).max
        level = len(gain) - 1 - int(np.argmin(gain[::-1]))  # the fullest of equals
        pieces = self.open[level].pop() if level else []
        if level:
            counts[level] -= 1
        pieces.append(piece)
        if level + size == full:
            return pieces
        counts[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def pour(self, finish: bool) -> Iterator[list[tuple]]:
        """Full windows from all that is open; at the end also the rest, cut at powers of two."""
        held, size = [], 0
        for level in range(self.window, 0, -1):
            for pieces in self.open[level]:
                for piece in pieces:
                    held.append(piece)
                    size += len(piece[2])
                    while size >= self.window:
                        done, held = _cut(held, self.window)
                        yield done
                        size -= self.window
            self.open[level] = []
        self.counts[:] = 0
        if finish:
            while size:
                done, held = _cut(held, 1 << size.bit_length() - 1)
                yield done
                size -= 1 << size.bit_length() - 1
        elif held:
            self.counts[size] = 1
            self.open[size] = [held]


def _cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first `size` ids, and the rest."""
    front, rest = [], []
    for doc, start, ids, tokens in pieces:
        take = min(size, len(ids))
        if take:
            front.append((doc, start, ids[:take], tokens))
        if take < len(ids):
            rest.append((doc, start + take, ids[take:], tokens))
        size -= take
    return front, rest


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    added: bool = False,
) -> DataFrame:
    """One row a piece: id, start in the document, length, ids (little-endian unsigned 32-bit, as binary), tokens of the
    document, sequence, offset there.

    Each document is its ids and END; each id lies in one piece. With `added`, strings of the file's added tokens get those
    tokens' ids, otherwise they are ordinary text. Null and empty texts are END alone. Sequences
    hold `window` ids; at the end of a task a few hold a smaller power of two, so none needs padding. The number of a
    sequence is that of its task (upper bits) and of its completion there. Repeated rows are packed each; an empty table
    gives an empty result; other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType)])
    for name in names[1:]:
        schema = schema.add(name, "binary" if name == "ids" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer, added), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 33
        id_type = None
        out: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in pieces:
                out.append((doc, start, len(ids), ids.tobytes(), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [id_type, *(pa.binary() if n == "ids" else pa.int64() for n in names[1:])]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                out.clear()
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.column(0).type
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.ids(text or "")
                    whole = len(ids) // window * window
                    for at in range(0, whole, window):
                        emit([(doc, at, ids[at : at + window], len(ids))])
                    if whole < len(ids) and (done := packer.place((doc, whole, ids[whole:], len(ids)))):
                        emit(done)
                if packer.counts.sum() > OPEN_WINDOWS:
                    for done in packer.pour(finish=False):
                        emit(done)
                yield from flush()
        for done in packer.pour(finish=True):
            emit(done)
        yield from flush()

    return map_texts(rows, run, schema)
