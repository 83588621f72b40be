"""Shards of equal bytes from a k-d tree over document metadata.

Equal texts are one point with their total weight, so that copies share a shard. A node of the tree splits along
the dimension in which its points lie widest, at the weighted quantile that gives each side its number of shards. The
quantile is found by distributed histograms which zoom in; the driver sees a bounded number of bins, never points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.llm.common import stored

#: Steps of a coordinate in each dimension, and of the tie-breaking hash below one step.
COORDINATE_BITS, TIE_BITS = 20, 40
#: Bins of a histogram, how often it zooms in at most (BINS ** ZOOMS is the number of keys), and the share of a shard a cut may be off.
BINS, ZOOMS, TOLERANCE = 1024, 6, 0.001
OVERHEAD = 8
DIMENSIONS = ("size", "lang", "source")


@dataclass
class Node:
    name: int
    shards: int
    first: int
    children: tuple[int, int] | None = None
    dimension: int = 0
    cut: int = 0


def _coordinates(size: Column, lang: Column | None, source: Column | None) -> list[Column]:
    """Each dimension as an integer of COORDINATE_BITS bits: size by its logarithm, names by their hash."""
    top = (1 << COORDINATE_BITS) - 1
    named = [F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % (top + 1) if c is not None else F.lit(0) for c in (lang, source)]
    return [F.least(F.lit(top), (F.log2(size.cast("double") + 1) * (top / 40)).cast("long")), *named]


def points(docs: DataFrame) -> DataFrame:
    """One point for each text: weight (bytes and row overhead of all copies) and a sort key in each dimension."""
    lang, source = ((F.min(c) if c in docs.columns else F.lit(None)) for c in ("lang", "source"))
    grouped = docs.groupBy("_text_hash", "_size").agg(
        F.sum("_size").alias("_weight"), lang.alias("_lang"), source.alias("_source")
    )
    tie = F.shiftrightunsigned(F.xxhash64("_text_hash"), 64 - TIE_BITS)
    keys = _coordinates(F.col("_size"), F.col("_lang"), F.col("_source"))
    return grouped.select(
        "_text_hash", "_size", "_weight",
        *[(F.shiftleft(k.cast("long"), TIE_BITS) + tie).alias(f"_d{i}") for i, k in enumerate(keys)],
    )


def _assigned(nodes: list[Node]) -> Column:
    """The leaf of a point, by the splits so far."""

    def walk(node: Node) -> Column:
        if node.children is None:
            return F.lit(node.name)
        low, high = (walk(nodes[c]) for c in node.children)
        return F.when(F.col(f"_d{node.dimension}") < node.cut, low).otherwise(high)

    return walk(nodes[0])


def _cases(values: dict[int, int | Column], default: int = 0) -> Column:
    out = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.col("_node") == name, value) if out is None else out.when(F.col("_node") == name, value)
    return out.otherwise(F.lit(default))


def kd_tree(cloud: DataFrame, shards: int) -> list[Node]:
    """Nodes of the tree, root first. All nodes of one depth are split by the same jobs."""
    nodes, depth = [Node(0, shards, 0)], [0]
    dims = [c for c in cloud.columns if c.startswith("_d")]
    while depth := [n for n in depth if nodes[n].shards > 1]:
        placed = cloud.withColumn("_node", _assigned(nodes)).filter(F.col("_node").isin(depth))
        bounds = placed.groupBy("_node").agg(
            F.sum("_weight").alias("w"),
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(dims)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(dims)],
        )
        spans, goal, below, best = {}, {}, {}, {}
        for row in bounds.collect():  # one row for each node of this depth
            name = row["_node"]
            wide = max(range(len(dims)), key=lambda i: (row[f"hi{i}"] - row[f"lo{i}"], -i))
            nodes[name].dimension = wide
            spans[name] = (row[f"lo{wide}"], row[f"hi{wide}"] + 1)
            goal[name] = row["w"] * (nodes[name].shards // 2) / nodes[name].shards
            below[name], best[name] = 0, (goal[name], spans[name][0])
            nodes[name].cut = spans[name][0]
        slack = {n: TOLERANCE * goal[n] / max(1, nodes[n].shards // 2) for n in goal}
        for _ in range(ZOOMS):
            open_nodes = [n for n in spans if spans[n][1] - spans[n][0] > 1 and best[n][0] > slack[n]]
            if not open_nodes:
                break
            step = {n: -(-(spans[n][1] - spans[n][0]) // BINS) for n in open_nodes}
            bins = (
                placed.filter(F.col("_node").isin(open_nodes))
                .select(
                    "_node",
                    "_weight",
                    _cases({n: F.col(dims[nodes[n].dimension]) for n in open_nodes}).alias("_key"),
                    _cases({n: spans[n][0] for n in open_nodes}).cast("long").alias("_lo"),
                    _cases({n: spans[n][1] for n in open_nodes}).cast("long").alias("_hi"),
                    _cases(step, 1).cast("long").alias("_step"),
                )
                .filter("_key >= _lo AND _key < _hi")
                .groupBy("_node", F.expr("(_key - _lo) div _step").alias("_bin"))
                .agg(F.sum("_weight").alias("w"))
            )
            found: dict[int, dict[int, int]] = {n: {} for n in open_nodes}
            for row in bins.collect():  # at most BINS rows for each node
                found[row["_node"]][row["_bin"]] = row["w"]
            for n in open_nodes:
                start, end = spans[n]
                for b in sorted(found[n]):
                    edge = start + (b + 1) * step[n]
                    for total, cut in ((below[n], start + b * step[n]), (below[n] + found[n][b], edge)):
                        if abs(total - goal[n]) < best[n][0]:
                            best[n] = (abs(total - goal[n]), cut)
                    if below[n] + found[n][b] >= goal[n]:
                        spans[n] = (start + b * step[n], min(edge, end))
                        break
                    below[n] += found[n][b]
                else:
                    spans[n] = (end, end)
        nxt = []
        for n in depth:
            node = nodes[n]
            left = node.shards // 2
            node.cut = best[n][1] if n in best else 0
            node.children = (len(nodes), len(nodes) + 1)
            nodes += [Node(len(nodes), left, node.first), Node(len(nodes) + 1, node.shards - left, node.first + left)]
            nxt += node.children
        depth = nxt
    return nodes


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, block_rows: int = 100_000
) -> DataFrame:
    """For each row: id, size, CRC-32 of its text, the law `bytes`, its shard, its place there.

    Shards hold nearly equal bytes (UTF-8 of the text, none for null, plus 8 a row), as far as equal texts, which
    always share a shard, allow. Places count from 0 without gaps, in blocks numbered on their own. Empty tables give an
    empty result; columns other than id, text, lang and source are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.xxhash64(text).alias("_text_hash"),
            *[F.col(c) for c in ("lang", "source") if c in docs.columns],
        ),
        "shards-meta",
    )
    cloud = stored(points(meta), "shards-points")
    nodes = kd_tree(cloud, shards)
    leaf = _cases({n.name: n.first for n in nodes if n.children is None})
    placed = cloud.withColumn("_node", _assigned(nodes)).select("_text_hash", "_size", leaf.cast("int").alias("shard"))
    rows = meta.join(placed, ["_text_hash", "_size"]).select("_id", "_size", "_crc", "shard")
    # Places: rows of a shard fall into blocks by a hash of the id; blocks are numbered from their sizes.
    total = meta.count()
    blocks = max(1, -(-total // block_rows))
    rows = stored(rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_crc"), F.lit(blocks))), "shards-rows")
    sizes = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_id", "_crc", "_size")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "_block"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
