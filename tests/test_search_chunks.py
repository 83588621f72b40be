"""Queries that are too many for one scan: cells of the index, next to all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episurv import registry
from episurv.operators.cells import build_cells, search_cells
from episurv.operators.search import knn, typed
from episurv.operators import cells


def frame(spark, vectors, kinds=None):
    rows = [(i, [float(x) for x in v], kinds[i] if kinds else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, kind string")


def brute(queries, corpus, k, allowed=lambda q, c: True):
    a, b = (np.array(x, np.float32).astype(float) for x in (queries, corpus))
    a, b = (x / np.maximum(1e-300, np.sqrt((x * x).sum(axis=1)))[:, None] for x in (a, b))
    scores = np.round(a @ b.T, 10)
    out = {}
    for q in range(len(a)):
        ids = [c for c in range(len(b)) if b[c].any() and a[q].any() and allowed(q, c)]
        if ids:
            out[q] = sorted(ids, key=lambda c: (-scores[q, c], c))[:k]
    return out


def ids(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def clustered(seed, n, dim=8, groups=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))


def test_both_ways_are_alike(spark):
    rng = np.random.default_rng(3)
    corpus = frame(spark, rng.normal(size=(40, 4)))
    queries = corpus.selectExpr("doc_id AS query_id", "embedding AS vector")
    few, many = knn(queries, corpus, k=2), knn(queries, corpus, k=2, max_carried=3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert knn(queries.limit(0), corpus).count() == 0
    assert knn(queries, corpus.limit(0), max_carried=3, dim=4).count() == 0


@pytest.mark.parametrize("block,query_block", [(4096, 1024), (7, 5)])
def test_cells_equal_all_pairs(spark, monkeypatch, block, query_block):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "QUERY_BLOCK", query_block)
    corpus = [*clustered(1, 300), *[clustered(1, 1)[0]] * 40, np.zeros(8)]  # a hot cell of copies, which tie
    queries = [*clustered(2, 30), *clustered(1, 20), np.zeros(8)]
    asked = frame(spark, queries).selectExpr("doc_id AS query_id", "embedding AS vector")
    odd = asked.limit(2).selectExpr("query_id + 1000 AS query_id", "IF(query_id = 0, NULL, slice(vector, 1, 3)) AS vector")
    index = build_cells(frame(spark, corpus).repartition(3), 8, cells=12)
    found, reads = search_cells(asked.union(odd), index, 5)
    assert ids(found) == brute(queries, corpus, 5)
    total = index.cells.agg(F.count("*"), F.sum("rows")).first()
    assert total[1] == 340
    share = reads.agg(F.avg("rows")).first()[0] / 340
    assert share < 0.6  # cells that cannot hold a better row are not read


def test_fewer_rows_than_wanted(spark):
    corpus = clustered(4, 6)
    index = build_cells(frame(spark, corpus), 8, cells=3)
    asked = frame(spark, clustered(5, 4)).selectExpr("doc_id AS query_id", "embedding AS vector")
    assert ids(search_cells(asked, index, 10).found) == brute(clustered(5, 4), corpus, 10)


def test_kinds_are_apart(spark):
    corpus, queries = clustered(6, 90), clustered(7, 30)
    kinds = [["a", "b", "c", None][i % 4] for i in range(90)]
    wanted = [["a", "b", None, "z"][i % 4] for i in range(30)]
    asked = frame(spark, queries, wanted).selectExpr("doc_id AS query_id", "embedding AS vector", "kind AS w")
    index = build_cells(frame(spark, corpus, kinds), 8, kind="kind", kinds=("a", "b"), cells=5)
    found = search_cells(asked, index, 4, wanted="w").found
    assert ids(found) == brute(queries, corpus, 4, lambda q, c: wanted[q] is None or wanted[q] in "ab" and kinds[c] == wanted[q])


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that the search writes, by name."""
    rows, stored = {}, cells._stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(cells, "_stored", counted)
    return rows


def test_tables_do_not_grow_with_pairs(spark, written):
    """Vectors in all directions rule out no cell, and still a query is not written once for each cell."""
    vectors = np.random.default_rng(8).normal(size=(300, 16))
    corpus = frame(spark, vectors)
    index = build_cells(corpus, 16, cells=30)
    found, reads = search_cells(corpus.selectExpr("doc_id AS query_id", "embedding AS vector"), index, 2)
    assert ids(found) == brute(vectors, vectors, 2)
    assert reads.agg(F.avg("cells")).first()[0] > 20
    assert max(written.values()) <= 600


def test_reads_need_no_second_round(spark, written):
    """What is read is known after the first round: no query is dealt to blocks for it."""
    vectors = clustered(9, 200)
    asked = frame(spark, vectors).selectExpr("doc_id AS query_id", "embedding AS vector")
    index = build_cells(frame(spark, vectors), 8, cells=12)
    want = sorted(map(tuple, search_cells(asked, index, 3).reads.collect()))
    assert sorted(map(tuple, cells.cells_read(asked, index, 3).collect())) == want and len(want) == 200
    written.clear()
    registry.load()
    assert registry.QUERIES["r7_cells_read"](spark, "/root/testdata/sf0.001").count() > 0
    assert "cells-bounded" in written and not {"cells-grouped", "cells-query-blocks"} & written.keys()


def test_nearest_cells_hold_the_rows_wanted(spark):
    """The first round's cells are those of a full sort by distance, ties in the order of cells, kinds apart."""
    rng = np.random.default_rng(10)
    vectors, kinds = rng.normal(size=(60, 4)), [["a", "b", None][i % 3] for i in range(60)]
    index = build_cells(frame(spark, vectors, kinds), 4, kind="kind", kinds=("a", "b"), cells=9)
    planner, units = cells._Planner(index, 7), rng.normal(size=(40, 4))
    wanted = np.arange(40) % 4 - 1  # any, a, b and a kind that no row has
    near = planner.near(units, wanted)
    for q in range(40):
        apart = cells._distances(units[q : q + 1], index.centres)[0][planner.cell]
        mine = [c for c in np.argsort(apart, kind="stable") if wanted[q] < 0 or planner.kind[c] == wanted[q]]
        before = np.cumsum([0, *planner.rows[mine]])[: len(mine)]
        assert set(np.flatnonzero(near[q])) == {c for c, held in zip(mine, before) if held < 7}


def test_tables_do_not_grow_with_pairs_of_kinds(spark, written):
    """A question of no type reads the cells of all types, and is not written once for each of them."""
    vectors = np.random.default_rng(11).normal(size=(300, 16))
    corpus = frame(spark, vectors, [["geographic", "temporal", "metric"][i % 3] for i in range(300)])
    corpus = corpus.withColumnRenamed("kind", "semantic_type")
    said = F.element_at(F.array(F.lit("oi"), F.lit("no ano"), F.lit("oi")), (F.col("doc_id") % 3 + 1).cast("int"))
    found = typed(corpus.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"), said.alias("text")), corpus, 2)
    assert ids(found) == brute(vectors, vectors, 2, lambda q, c: q % 3 != 1 or c % 3 == 1)
    assert max(written.values()) <= 900


def test_a_hot_cell_gives_a_bound_by_some_blocks(spark, monkeypatch):
    """The first round wants k rows, not all blocks of a hot cell for each query in it, and takes all of these blocks in turn."""
    monkeypatch.setattr(cells, "BLOCK", 40)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 10)
    met, best_of = [], cells._best_of
    monkeypatch.setattr(cells, "_best_of", lambda found, k: met.append(found.select("query_id", "id").distinct().collect()) or best_of(found, k))
    vectors = [*np.tile(clustered(12, 1), (600, 1)), *clustered(13, 20)]  # 15 blocks of copies
    corpus = frame(spark, vectors)
    asked = corpus.filter("doc_id % 5 = 0").selectExpr("doc_id AS query_id", "embedding AS vector")
    found = search_cells(asked, build_cells(corpus, 8, cells=4), 3).found
    assert ids(found) == {q: best for q, best in brute(vectors, vectors, 3).items() if q % 5 == 0}
    hot = [r["id"] for r in met[0] if r["query_id"] < 600]
    assert len(hot) <= 120 * 3 and len(set(hot)) > 3 * 3


@pytest.mark.parametrize("element,size", [("float", 4), ("double", 8)])
def test_vectors_are_written_as_they_come(spark, monkeypatch, element, size):
    """Floats take half the bytes of doubles in every table, and short vectors keep their direction."""
    tables, stored = {}, cells._stored
    monkeypatch.setattr(cells, "_stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    vectors = clustered(14, 60)
    vectors[::7] *= 1e-30  # whose squares are no floats
    corpus = frame(spark, vectors).withColumn("embedding", F.col("embedding").cast(f"array<{element}>"))
    found = search_cells(corpus.selectExpr("doc_id AS query_id", "embedding AS vector"), build_cells(corpus, 8, cells=5), 2).found
    assert ids(found) == brute(vectors, vectors, 2)
    assert {dict(t.dtypes)["vector"] for t in tables.values() if "vector" in t.columns} == {f"array<{element}>"}
    for name in ("cells-blocks", "cells-query-blocks"):
        assert tables[name].agg(F.sum(F.length("_vectors"))).first()[0] == 60 * 8 * size
    # The vectors of queries: as asked, by their nearest cells, and with their bound, then in blocks.
    assert {name for name in tables if "vector" in tables[name].columns} == {"cells-rows", "cells-queries", "cells-near", "cells-bounded"}


def test_texts_of_questions_do_not_move(spark, monkeypatch):
    """The type of a question is taken where its text is read: no join has texts on a side."""
    plans, stored = [], cells._stored
    monkeypatch.setattr(cells, "_stored", lambda df, name: plans.append(df) or stored(df, name))
    registry.load()
    plans.append(registry.QUERIES["r10_typed"](spark, "/root/testdata/sf0.001"))
    sides = []

    def walk(node):
        below = [node.children().apply(n) for n in range(node.children().size())]
        if node.nodeName() == "Join":
            sides.extend(child.output().mkString(",") for child in below)
        for child in below:
            walk(child)

    for df in plans:
        walk(df._jdf.queryExecution().optimizedPlan())
    assert sides and not [side for side in sides if "text#" in side]
