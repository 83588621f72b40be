"""Vectors in Arrow batches: unit rows, and the best of many scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Scores are compared at this precision, so copies of one vector tie and go by id.
SCORE_DIGITS = 10


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    good = norms > 0
    return matrix[good] / norms[good, None], good


class Best:
    """The k best (score, id) of each query seen so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores: list[np.ndarray] = [np.empty(0)] * len(queries)
        self.ids: list[np.ndarray | None] = [None] * len(queries)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        unit, good = unit_rows(vectors)
        ids = ids[good]
        if not len(ids):
            return
        scores = np.round(self.queries @ unit.T, SCORE_DIGITS)
        for q in range(len(self.queries)):
            row = scores[q]
            floor = self.scores[q][self.k - 1] if len(self.scores[q]) >= self.k else -np.inf
            if len(row) > self.k:
                floor = max(floor, np.partition(row, len(row) - self.k)[len(row) - self.k])
            near = row >= floor
            s, i = row[near], ids[near]
            if self.ids[q] is not None:
                s, i = np.concatenate([self.scores[q], s]), np.concatenate([self.ids[q], i])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]

    def rows(self, query_ids: Sequence) -> pd.DataFrame:
        return pd.DataFrame(
            [
                (query, id_.item(), score)
                for query, ids, scores in zip(query_ids, self.ids, self.scores)
                if ids is not None
                for id_, score in zip(ids, scores)
            ],
            columns=["query_id", "id", "score"],
        )


class BlockBest:
    """The k best (score, id) of each query of a block, for many queries and few ids that still count: all are merged at once.

    A query has no use for scores below its floor. `SCORED` pairs are scored at a time.
    """

    SCORED = 1 << 20

    def __init__(self, query_ids: Sequence, queries: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.floor = np.where(np.isnan(floor), -np.inf, floor)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, asking: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Compare the queries of these numbers with unit vectors."""
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype), copy=False)
        step = max(1, self.SCORED // max(1, len(ids)))
        for lo in range(0, len(asking), step):
            rows = asking[lo : lo + step]
            scores = self.queries[rows] @ units.T
            at, which = np.nonzero(scores >= self.floor[rows, None] - 10.0**-SCORE_DIGITS)
            self._merge(rows[at], np.round(scores[at, which], SCORE_DIGITS), ids[which])

    def _merge(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last = self.scores[at, -1]
        better = (scores > last) | ((scores == last) & (ids < self.ids[at, -1]))
        at, scores, ids = at[better], scores[better], ids[better]
        if not len(at):
            return
        changed = np.unique(at)
        at = np.concatenate([at, np.repeat(changed, self.k)])
        scores, ids = np.concatenate([scores, self.scores[changed].ravel()]), np.concatenate([ids, self.ids[changed].ravel()])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < self.k
        self.scores[at[top], place[top]], self.ids[at[top], place[top]] = scores[top], ids[top]
        self.floor[changed] = np.maximum(self.floor[changed], self.scores[changed, -1])

    def rows(self) -> pd.DataFrame:
        at, place = np.nonzero(np.isfinite(self.scores))
        ids = self.ids[at, place] if self.ids is not None else []
        return pd.DataFrame({"query_id": [self.query_ids[n] for n in at], "id": ids, "score": self.scores[at, place]})


def key_type(df: DataFrame, name: str) -> str:
    """Ids are whole numbers or text."""
    return "bigint" if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def element_type(df: DataFrame, name: str) -> str:
    """Vectors are kept as they come, of floats in half the bytes, and compared as doubles."""
    return "float" if df.schema[name].dataType.simpleString() == "array<float>" else "double"


def found_schema(query_type: str, id_type: str) -> tuple[str, pa.Schema]:
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    fields = [("query_id", arrow[query_type]), ("id", arrow[id_type]), ("score", pa.float64())]
    return f"query_id {query_type}, id {id_type}, score double", pa.schema(fields)


def ids_of(values: np.ndarray) -> np.ndarray:
    """Ids in a type that sorts; text arrives as objects."""
    return values.astype(str) if values.dtype == object else values


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
