"""Exact vector search over an inverted-file index: cells of similar vectors, of which only those are read that can hold a better one.

Every row of the corpus is assigned to the nearest of the cells' centres; a cell keeps the largest distance of its rows, its radius.
A query first reads its nearest cells, until they hold k rows. Its k-th score then rules cells out: by the triangle inequality no row
of a cell is nearer than the distance of its centre less its radius. What is left is read in a second round, so the result is
exact whatever the centres are. They are fitted by k-means on a sample, and on nothing else does the sample have an effect.

Cells are cut into blocks of rows, queries into blocks too, and the unit of work is a pair of blocks. So a cell that
holds a large share of the corpus, or that most queries ask for, spreads over as many tasks as it has pairs, and no vector
passes through the driver but the centres. A query moves with its few nearest cells in the first round, with a block of each if that
holds k rows, and once with its block in the second, where stored blocks of queries and of rows are paired in place: what is written
and shuffled grows with rows and queries, not with their pairs. Vectors are written as they come, floats as floats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.operators.vectors import Best, BlockBest, element_type, found_schema, ids_of, key_type, matrix_of, unit_rows
from episurv.session import scratch_path

# Rows the centres are fitted on, about; most cells; passes of k-means.
SAMPLE, MOST_CELLS, PASSES = 20_000, 1024, 5
# Rows of a block of the corpus, and of queries.
BLOCK, QUERY_BLOCK = 4096, 2048
# Query blocks whose best a task keeps; vectors compared with all centres at once.
KEPT_BLOCKS, PLANNED = 16, 256
# The bytes of a vector's numbers, by their type in tables.
NUMBERS = {"float": np.float32, "double": np.float64}
# Scores are rounded, so a cell is read that falls short by less than this.
SLACK = 1e-9


class CellIndex(NamedTuple):
    """`blocks` and `cells` are tables in the shared folder; centres and what the planner knows of each cell travel with tasks.

    `cells` has one row for each kind and cell that holds rows: _kind, _cell, rows, radius. `element` is the type of the numbers in
    the vectors of `blocks`.
    """

    blocks: DataFrame
    cells: DataFrame
    centres: np.ndarray
    kinds: tuple[str | None, ...]
    id_type: str
    element: str


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _has_direction(vector: str) -> Column:
    """Neither zero nor with a NaN, which Spark takes for the largest number."""
    norm = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return (norm > 0) & ~F.isnan(norm)


def _fitted(rows: DataFrame, total: int, count: int, sample: int) -> np.ndarray:
    """Centres of unit vectors, by k-means on the rows whose hashes of ids are in a share of the hash range."""
    share = min(1.0, sample / max(1, total))
    chosen = rows.filter((F.col("_at") >= 0) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    vectors = Normalizer(p=2.0, inputCol="raw", outputCol="features").transform(chosen.select(array_to_vector(F.col("vector").cast("array<double>")).alias("raw")))
    model = KMeans(k=max(2, count), seed=7, maxIter=PASSES, initMode="random").fit(vectors.select("features"))
    return np.array(model.clusterCenters())


def build_cells(
    corpus: DataFrame,
    dim: int,
    doc_id: str = "doc_id",
    vector: str = "embedding",
    kind: str | None = None,
    kinds: Sequence[str] = (),
    cells: int | None = None,
    sample: int = SAMPLE,
) -> CellIndex:
    """An index of all rows whose vector has length `dim` and is not zero.

    `cells` is by default the square root of the number of rows, at most MOST_CELLS. With `kind`, a column of the corpus, rows of
    each of `kinds` are cells apart, so that a search for one kind reads no other; all further values are one kind.
    """
    id_type, element = key_type(corpus, doc_id), element_type(corpus, vector)
    apart = F.lit(-1) if kind is None else F.coalesce(*[F.when(F.col(kind) == k, n) for n, k in enumerate(kinds)], F.lit(-1))
    rows = corpus.filter(F.size(F.coalesce(F.col(vector), F.array().cast("array<float>"))) == dim).select(
        F.col(doc_id).cast(id_type).alias("id"), F.col(vector).cast(f"array<{element}>").alias("vector"), apart.cast("int").alias("_kind")
    )
    rows = rows.withColumn("_at", F.when(_has_direction("vector"), 0).otherwise(-1)).filter("_at = 0")
    total = rows.count()
    count = cells or min(MOST_CELLS, isqrt(total))
    centres = _fitted(rows, total, count, sample) if total and dim else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PLANNED):
                part = batch.slice(lo, PLANNED)
                units, _ = unit_rows(matrix_of(part.column("vector"), dim))
                apart = _distances(units, centres)
                nearest = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "vector", "_kind")), pa.array(nearest.astype(np.int32)), pa.array(apart[np.arange(len(units)), nearest])],
                    ["id", "vector", "_kind", "_cell", "_apart"],
                )

    placed = rows.select("id", "vector", "_kind").mapInArrow(
        assign, f"id {id_type}, vector array<{element}>, _kind int, _cell int, _apart double"
    )
    placed = _stored(placed, "cells-rows")
    table = _stored(placed.groupBy("_kind", "_cell").agg(F.count("*").alias("rows"), F.max("_apart").alias("radius")), "cells")
    place = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK)).cast("int")
    blocks = (
        placed.join(table, ["_kind", "_cell"])
        .groupBy("_kind", "_cell", place.alias("_block"))
        .agg(F.collect_list(F.struct("id", "vector")).alias("_rows"))
    )
    blocks = _packed(blocks, dim, id_type, element, "_kind int, _cell int, _block int")
    return CellIndex(_stored(blocks, "cells-blocks"), table, centres, tuple(kinds) if kind else (), id_type, element)


def _packed(groups: DataFrame, dim: int, id_type: str, element: str, others: str) -> DataFrame:
    """The ids and vectors in `_rows` as `_ids` and `_vectors`, the bytes of their numbers."""
    names = [c for c in groups.columns if c != "_rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                rows = batch.column("_rows")[n].values
                vectors = matrix_of(rows.field("vector"), dim).astype(NUMBERS[element])
                ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.field("id"))
                others = [batch.column(c).slice(n, 1) for c in names]
                yield pa.RecordBatch.from_arrays([*others, ids, pa.array([vectors.tobytes()], pa.binary())], [*names, "_ids", "_vectors"])

    return groups.mapInArrow(run, f"{others}, _ids array<{id_type}>, _vectors binary")


def _vectors_of(value: pa.Scalar, dim: int, element: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), NUMBERS[element]).reshape(-1, dim).astype(np.float64)


def _units_of(value: pa.Scalar, dim: int, element: str) -> np.ndarray:
    return unit_rows(_vectors_of(value, dim, element))[0]


def _cell_key(kind: str, cell: str) -> Column:
    return (F.col(kind).cast("bigint") + 1) * F.lit(1 << 32) + F.col(cell)


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (units * units).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * units @ centres.T
    return np.sqrt(np.maximum(square, 0))


class _Planner:
    """Which cells a query reads. It knows each cell's number of rows and radius: a row for each kind and cell, of which there are at
    most MOST_CELLS for each kind."""

    def __init__(self, index: CellIndex, k: int):
        known = [(r["_kind"], r["_cell"], r["rows"], r["radius"]) for r in index.cells.collect()]
        columns = list(zip(*sorted(known))) or [()] * 4
        self.kind, self.cell, self.rows = (np.array(c, np.int64) for c in columns[:3])
        self.radius, self.centres, self.k = np.array(columns[3], float), index.centres, k
        self.keys = (self.kind + 1) * (1 << 32) + self.cell
        self.number = {int(key): n for n, key in enumerate(self.keys)}

    def near(self, units: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each query the cells of the first round: its nearest ones, until they hold k rows. A wanted kind of -1 is any."""
        apart = np.where(self._mine(wanted, slice(None)), _distances(units, self.centres)[:, self.cell], np.inf)
        near, held = np.zeros(apart.shape, bool), np.zeros(len(apart), np.int64)
        for _ in range(min(self.k, apart.shape[1])):  # a cell holds a row at least
            nearest = apart.argmin(axis=1)
            short = np.flatnonzero((held < self.k) & np.isfinite(apart[np.arange(len(apart)), nearest]))
            if not len(short):
                break
            cells = nearest[short]
            near[short, cells], apart[short, cells] = True, np.inf
            held[short] += self.rows[cells]
        return near

    def open(self, units: np.ndarray, wanted: np.ndarray, worst: np.ndarray, cells: slice | Sequence[int] = slice(None)) -> np.ndarray:
        """For each query which of the cells its k-th score (NaN if there are fewer rows) does not rule out."""
        centres, at = np.unique(self.cell[cells], return_inverse=True)
        nearest = np.maximum(0, _distances(units, self.centres[centres])[:, at] - self.radius[cells])
        best = 1 - nearest * nearest / 2  # the largest cosine a row of the cell can have
        return self._mine(wanted, cells) & (np.isnan(worst)[:, None] | (best >= worst[:, None] - SLACK))

    def _mine(self, wanted: np.ndarray, cells: slice | Sequence[int]) -> np.ndarray:
        return (wanted[:, None] < 0) | (self.kind[cells] == wanted[:, None])


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Queries with their unit vectors and wanted kinds, some at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PLANNED):
            part = batch.slice(lo, PLANNED)
            units, _ = unit_rows(matrix_of(part.column("vector"), dim))
            yield part, units, np.asarray(part.column("_wanted"))


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles, null as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _near(queries: DataFrame, planner: _Planner, dim: int, query_type: str) -> DataFrame:
    """A row for each query and cell of its first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, units, wanted in _parts(batches, dim):
            at, cells = np.nonzero(planner.near(units, wanted))
            rows = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("query_id"),
                    rows.column("vector"),
                    pa.array(planner.kind[cells].astype(np.int32)),
                    pa.array(planner.cell[cells].astype(np.int32)),
                ],
                ["query_id", "vector", "_kind", "_cell"],
            )

    element = element_type(queries, "vector")
    return queries.select("query_id", "vector", "_wanted").mapInArrow(
        run, f"query_id {query_type}, vector array<{element}>, _kind int, _cell int"
    )


def _read(queries: DataFrame, planner: _Planner, dim: int, query_type: str) -> DataFrame:
    """The number of cells, and of their rows, that each query reads in both rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, units, wanted in _parts(batches, dim):
            read = planner.near(units, wanted) | planner.open(units, wanted, _numbers(part.column("_worst")))
            some = read.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id"), pa.array(read.sum(axis=1)), pa.array(read @ planner.rows)], ["query_id", "cells", "rows"]
            ).filter(pa.array(some))

    return queries.select("query_id", "vector", "_wanted", "_worst").mapInArrow(run, f"query_id {query_type}, cells bigint, rows bigint")


def _grouped(queries: DataFrame, total: int, planner: _Planner, dim: int, query_type: str) -> DataFrame:
    """Of `total` queries each with the number of its group, of those in cells next to each other in number, in `_group`."""
    count = max(1, len(planner.centres))
    groups = min(count, max(1, -(-total // QUERY_BLOCK)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, units, _ in _parts(batches, dim):
            group = _distances(units, planner.centres).argmin(axis=1) * groups // count
            columns = [part.column(c) for c in ("query_id", "vector", "_wanted", "_worst")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(group.astype(np.int32))], ["query_id", "vector", "_wanted", "_worst", "_group"])

    schema = f"query_id {query_type}, vector array<{element_type(queries, 'vector')}>, _wanted int, _worst double, _group int"
    return queries.select("query_id", "vector", "_wanted", "_worst").mapInArrow(placed, schema)


def _query_blocks(rows: DataFrame, planner: _Planner, dim: int, query_type: str) -> DataFrame:
    """Blocks of queries that want one kind and are of one group: `_ids`, `_vectors`, `_worsts`, and in `_open` the keys of all
    cells that one of them has to read."""
    element = element_type(rows, "vector")
    sizes = rows.groupBy("_wanted", "_group").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_parts"))
    place = F.pmod(F.xxhash64("query_id"), F.col("_parts"))
    row = F.struct(F.col("query_id").alias("id"), "vector", "_worst")
    blocks = rows.join(sizes, ["_wanted", "_group"]).groupBy("_wanted", "_group", place.alias("_part")).agg(F.collect_list(row).alias("_rows"))
    blocks = blocks.select("_wanted", F.col("_rows._worst").alias("_worsts"), "_rows")
    packed = _packed(blocks, dim, query_type, element, "_wanted int, _worsts array<double>")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for n in range(batch.num_rows):
                units, worst = _units_of(batch.column("_vectors")[n], dim, element), _numbers(batch.column("_worsts")[n].values)
                wanted, some = np.full(len(units), batch.column("_wanted")[n].as_py()), np.zeros(len(planner.keys), bool)
                for lo in range(0, len(units), PLANNED):
                    at = slice(lo, lo + PLANNED)
                    some |= planner.open(units[at], wanted[at], worst[at]).any(axis=0)
                lists.append(planner.keys[some])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "_open"])

    fields = f"_wanted int, _worsts array<double>, _ids array<{query_type}>, _vectors binary, _open array<bigint>"
    blocks = packed.mapInArrow(opened, fields).withColumn("_query_block", F.monotonically_increasing_id())
    return _stored(blocks, "cells-query-blocks")


def _paired(query_blocks: DataFrame, index: CellIndex, planner: _Planner, k: int, dim: int, query_type: str, element: str) -> DataFrame:
    """The k best of each query among the blocks that a task pairs with it. Both sides are read where they were written: a product of
    few large rows, whose condition leaves out pairs with cells that no query of the block has to read."""
    rows = index.blocks.select(
        _cell_key("_kind", "_cell").alias("_key"), F.col("_ids").alias("_row_ids"), F.col("_vectors").alias("_row_vectors")
    )
    both = query_blocks.join(rows, F.array_contains("_open", F.col("_key"))).drop("_open")
    schema, arrow = found_schema(query_type, index.id_type)
    row_element = index.element

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, BlockBest] = {}

        def ended(block: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(kept.pop(block).rows(), schema=arrow, preserve_index=False)

        for batch in batches:
            for n in range(batch.num_rows):
                block = batch.column("_query_block")[n].as_py()
                if block not in kept:
                    if len(kept) >= KEPT_BLOCKS:
                        yield ended(next(iter(kept)))
                    worst = _numbers(batch.column("_worsts")[n].values)
                    units = _units_of(batch.column("_vectors")[n], dim, element)
                    kept[block] = BlockBest(batch.column("_ids")[n].as_py(), units, k, worst - 2 * SLACK)
                best = kept[block] = kept.pop(block)  # the one met last is the last to go
                wanted = np.full(len(best.queries), batch.column("_wanted")[n].as_py())
                cell = planner.number[batch.column("_key")[n].as_py()]
                worst = _numbers(batch.column("_worsts")[n].values)
                asking = np.flatnonzero(planner.open(best.queries, wanted, worst, [cell])[:, 0])
                ids = ids_of(batch.column("_row_ids")[n].values.to_numpy(zero_copy_only=False))
                best.add(asking, ids, _units_of(batch.column("_row_vectors")[n], dim, row_element))
        for block in list(kept):
            yield ended(block)

    return both.mapInArrow(run, schema)


def _searched(plan: DataFrame, index: CellIndex, k: int, dim: int, query_type: str) -> DataFrame:
    """The k best of each query in each cell that the plan names for it, or in some blocks of the cell that are likely to hold k rows:
    any k rows give a bound. Other blocks for other parts of the queries, so that all of a hot cell's blocks have their share of tasks."""
    asked = plan.groupBy("_kind", "_cell").agg(F.count("*").alias("_asked")).join(index.cells, ["_kind", "_cell"])
    asked = _stored(asked.select("_kind", "_cell", "_asked", F.ceil(F.col("rows") / BLOCK).cast("int").alias("_blocks")), "cells-asked")
    place = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("_asked") / QUERY_BLOCK))
    packed = (
        plan.join(asked, ["_kind", "_cell"])
        .groupBy("_kind", "_cell", place.alias("_part"))
        .agg(F.collect_list(F.struct("query_id", "vector")).alias("_queries"), F.first("_blocks").alias("_blocks"))
    )
    some = F.least("_blocks", F.lit(-(-4 * k // BLOCK)))  # blocks are half full at least, but for chance
    turn = F.explode(F.sequence(F.lit(0), some - 1))
    pairs = packed.select("_kind", "_cell", "_queries", "_part", "_blocks", turn.alias("_turn"))
    pairs = pairs.withColumn("_block", F.pmod(F.col("_part") + F.col("_turn"), F.col("_blocks")).cast("int"))
    both = pairs.join(index.blocks, ["_kind", "_cell", "_block"]).select("_queries", "_ids", "_vectors")
    schema, arrow = found_schema(query_type, index.id_type)
    element = index.element

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                queries = batch.column("_queries")[n].values
                units, _ = unit_rows(matrix_of(queries.field("vector"), dim))
                best = Best(units, k)
                best.add(ids_of(batch.column("_ids")[n].values.to_numpy(zero_copy_only=False)), _vectors_of(batch.column("_vectors")[n], dim, element))
                found = best.rows(queries.field("query_id").to_pylist())
                yield pa.RecordBatch.from_pandas(found, schema=arrow, preserve_index=False)

    return both.mapInArrow(run, schema)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Search(NamedTuple):
    """found: query_id, id, score, rank. reads: query_id and number of cells, of rows, that it read."""

    found: DataFrame
    reads: DataFrame


def _first_round(
    queries: DataFrame, index: CellIndex, k: int, query_id: str, query_vector: str, wanted: str | Column | None, grouped: bool
) -> tuple[DataFrame, _Planner, str]:
    """The queries that take part, with their k-th score among rows of their nearest cells in `_worst`, null if these are fewer, and
    if `grouped` their `_group`; the planner, and the type of the queries' ids."""
    dim, query_type, element = index.centres.shape[1], key_type(queries, query_id), element_type(queries, query_vector)
    named = F.lit(None).cast("string") if wanted is None else (F.col(wanted) if isinstance(wanted, str) else wanted)
    number = F.coalesce(*[F.when(named == kind, n) for n, kind in enumerate(index.kinds)], F.when(named.isNull(), -1), F.lit(len(index.kinds)))
    asked = queries.select(
        F.col(query_id).cast(query_type).alias("query_id"),
        F.col(query_vector).cast(f"array<{element}>").alias("vector"),
        number.cast("int").alias("_wanted"),
    ).filter(F.size(F.coalesce("vector", F.array().cast(f"array<{element}>"))) == dim)
    asked = _stored(asked.filter(_has_direction("vector")), "cells-queries")
    planner = _Planner(index, k)
    near = _stored(_near(asked, planner, dim, query_type), "cells-near")
    first = _best_of(_searched(near, index, k, dim, query_type), k)
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("_worst"))
    bounded = asked.join(worst, "query_id", "left")
    if grouped:
        bounded = _grouped(bounded, asked.count(), planner, dim, query_type)
    return _stored(bounded, "cells-bounded"), planner, query_type


def search_cells(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
    wanted: str | Column | None = None,
) -> Search:
    """The k rows of the index that are most similar to each query, by score and then id; exact.

    `wanted` names a kind for each query, or null for any. Zero and missing vectors, and those of another length, take no
    part. Both rounds are joins of query blocks with corpus blocks; their plans are written to the shared folder.
    """
    dim = index.centres.shape[1]
    bounded, planner, query_type = _first_round(queries, index, k, query_id, query_vector, wanted, grouped=True)
    # What the first round found is found again, as no k-th score rules out the cell of a better row.
    blocks = _query_blocks(bounded, planner, dim, query_type)
    found = _best_of(_paired(blocks, index, planner, k, dim, query_type, element_type(bounded, "vector")), k)
    return Search(found, _read(bounded, planner, dim, query_type))


def cells_read(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
    wanted: str | Column | None = None,
) -> DataFrame:
    """The `reads` of `search_cells`. They are known after the first round, so nothing is made ready for a second."""
    bounded, planner, query_type = _first_round(queries, index, k, query_id, query_vector, wanted, grouped=False)
    return _read(bounded, planner, index.centres.shape[1], query_type)
