"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is bound from the vectors of its
letters, each permuted by its place (rolled by two, one, none) and multiplied. A document is the bundle, the sum, of its
trigram vectors; a language is the bundle of its documents' unit vectors. A document gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episurv.llm.common import map_texts

UNKNOWN = "und"
DIMENSIONS = 512
#: Labelled documents that a language is learnt from: those with the smallest hashes of their ids.
TRAIN_ROWS = 1000
#: Trigram vectors a task keeps; all are derived again when more come up.
KEPT_TRIGRAMS = 1 << 15


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """For each code point: itself in lower case if a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """+1 and -1 in DIMENSIONS places, from a generator that each code point seeds; 0 stands for a word's end."""
    return np.stack([np.random.default_rng(int(c)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1 for c in letters])


class Profiles:
    """Unit vectors of documents; trigram vectors are kept from one document to the next."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1024, DIMENSIONS), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = letter_vectors(np.array([code]))[0]
        return self.letters[code]

    def _bind(self, codes: list[int]) -> None:
        for code in codes:
            if len(self.place) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
            self.rows[len(self.place)] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            self.place[code] = len(self.place)

    def vector(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        points = letter_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        keep = points > 0
        if not keep.any():
            return None
        keep[1:] |= keep[:-1].copy()  # one 0 after each word
        seq = np.r_[0, points[keep], 0]
        codes = seq[:-2] << 42 | seq[1:-1] << 21 | seq[2:]
        codes, counts = np.unique(codes[(seq[1:-1] > 0)], return_counts=True)
        total = np.zeros(DIMENSIONS, np.float32)
        for at in range(0, len(codes), KEPT_TRIGRAMS // 2):
            part = codes[at : at + KEPT_TRIGRAMS // 2].tolist()
            if len(self.place) + len(part) > KEPT_TRIGRAMS:
                self._reset()
            place = self.place
            self._bind([c for c in part if c not in place])
            rows = np.array([place[c] for c in part])
            weights = counts[at : at + len(part)].astype(np.float32)
            for lo in range(0, len(rows), 1024):
                total += weights[lo : lo + 1024] @ self.rows[rows[lo : lo + 1024]].astype(np.float32)
        size = float(np.sqrt(total @ total))
        return total / size if size else total


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.column(name).slice(at, 256).to_pylist()


def _by_language(values: dict[str, int]):
    return F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for pair in values.items() for x in pair])[
        F.col("_lang")
    ]


def prototypes(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """A unit vector for each language, from at most `rows` documents of each (more where hashes tie).

    What reaches the driver is one number and one vector a language; texts do not move.
    """
    known = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(id_col).alias("_rank")
    )
    # Hashes are spread evenly, so a share of their range holds a few times the rows wanted, whatever the table's size.
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}  # a number for each language
    if not counts:
        return {}
    share = {lang: min(1.0, 4 * (rows + 25) / n) for lang, n in counts.items()}
    bound = {lang: min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)) for lang, s in share.items()}
    first = Window.partitionBy("_lang").orderBy("_rank")
    limits = (
        known.select("_lang", "_rank")
        .filter(F.col("_rank") <= _by_language(bound))
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= rows)
        .groupBy("_lang")
        .agg(F.max("_rank").alias("_last"))
    )
    last = {r["_lang"]: r["_last"] for r in limits.collect()}
    sample = known.filter(F.col("_rank") <= _by_language(last)).select("_lang", "_text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), {}
        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), _texts(batch, "_text")):
                vector = profiles.vector(text) if text else None
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["_lang", "_v"]
            )

    parts = map_texts(sample, bundle, "_lang string, _v array<double>")
    summed = (
        parts.select("_lang", F.posexplode("_v").alias("_at", "_x"))
        .groupBy("_lang", "_at")
        .agg(F.sum("_x").alias("_x"))
        .groupBy("_lang")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_x")))["_x"].alias("_v"))
    )
    out = {r["_lang"]: np.array(r["_v"]) for r in summed.collect()}
    return {lang: v / max(1e-12, float(np.sqrt(v @ v))) for lang, v in sorted(out.items())}


def identify(
    docs: DataFrame,
    learnt: dict[str, np.ndarray],
    text_col: str = "text",
    lang_out: str = "lang_pred",
    score_out: str = "score",
) -> DataFrame:
    """All columns of `docs`, then language and score; input columns of those two names are replaced.

    The score is the cosine with the language's prototype, between 0 and 1. A text that is null or has no
    letter is `und` with score 0, and so is every text if nothing was learnt. Rows are judged one by one, whole texts.
    """
    names, matrix = list(learnt), np.array(list(learnt.values()), np.float32)
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields]).add(lang_out, "string").add(score_out, "double")
    at = kept.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            langs, scores = [], []
            for lo in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(lo, 256).to_pylist():
                    vector = profiles.vector(text) if text and names else None
                    if vector is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        cosines = matrix @ vector
                        best = int(np.argmax(cosines))
                        langs.append(names[best])
                        scores.append(min(1.0, max(0.0, round(float(cosines[best]), 6))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, lang_out, score_out]
            )

    return map_texts(rows, predict, schema)


def held_out(id_col: str = "doc_id"):
    """A quarter of the documents, by CRC-32 of the id's text, is not learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
