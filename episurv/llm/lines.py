"""Line deduplication by winnowing over line hashes.

Each solid line of a text has a hash. A window is the run of lines from one line on that reaches the least number of words or of
lines; the line with the smallest hash in it is its guaranteed fingerprint. Fingerprints that stand in one place only
are out. Windows around the others are joined with the earliest place of the same window, and each such match is extended both ways,
line by line, as long as both places go on alike; what the matches of a document cover together are its later repeats, which
are deleted. Places are compared with the earliest one of their window only, never with each other.

Texts stay in Spark expressions from end to end; only the hashes of lines go through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from episurv.llm.common import KEY, SPACES, key_columns, mixed, others, shuffled, stored

#: Words, or else lines, of the shortest repeat that is deleted.
WORDS, LINES = 50, 4
_BLANKS = r"[\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _k, _h, _lines): for each solid line where it stands, its words, two hashes.

    A line is what stands between line feeds, taken without white space at its ends; it is solid if something is left.
    """
    content = F.transform(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(SPACES)))
    numbered = F.transform(content, lambda x, i: F.struct(i.alias("at"), x.alias("s")))
    solid = F.filter(numbered, lambda x: x["s"] != "")
    hashed = F.transform(
        solid,
        lambda x: F.struct(
            x["at"].alias("at"),
            F.size(F.split(x["s"], _BLANKS)).alias("words"),
            F.xxhash64(x["s"]).alias("a"),
            F.xxhash64(F.lit(7), x["s"]).alias("b"),
        ),
    )
    return docs.select(
        F.col(id_col).alias("_id"),
        *key_columns(id_col, text_col),
        F.coalesce(hashed, F.array().cast("array<struct<at:int,words:int,a:bigint,b:bigint>>")).alias("_lines"),
    )


def window_ends(words: np.ndarray, least_words: int, least_lines: int) -> np.ndarray:
    """For each line the line after the window that begins there; beyond the last line if the text ends before."""
    total = np.r_[0, np.cumsum(words)]
    by_words = np.searchsorted(total, total[:-1] + least_words)
    by_lines = np.arange(len(words)) + least_lines
    ends = np.minimum(by_words, by_lines)
    return np.where(ends <= len(words), ends, len(words) + 1)


def _windows(batches: Iterator[pa.RecordBatch], words: int, lines: int) -> Iterator[pa.RecordBatch]:
    """Each window: place, fingerprint (least first hash of its lines) and a hash of its lines' second hashes."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        table = batch.column("_lines")
        sizes = np.asarray(pa.compute.list_value_length(table))
        flat = table.flatten()
        n_words, a, b = (np.asarray(flat.field(c)) for c in ("words", "a", "b"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        first = np.cumsum(np.r_[0, sizes])
        # Lines of the batch count on through its documents; a window ends within its own.
        starts, ends = [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if lo < hi:
                of_doc = window_ends(n_words[lo:hi], words, lines) + lo
                whole = np.flatnonzero(of_doc <= hi)
                starts.append(whole + lo)
                ends.append(of_doc[whole])
        if not starts:
            continue
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        low, code = np.full(len(starts), np.iinfo(np.uint64).max), (ends - starts).astype(np.uint64)
        for step in range(int((ends - starts).max(initial=0))):
            inside = np.flatnonzero(starts + step < ends)
            here = starts[inside] + step
            code[inside] = mixed(code[inside] * factor + b[here])
            low[inside] = np.minimum(low[inside], a[here])
        row = np.searchsorted(first, starts, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(row)) for c in ("_id", "_k")),
                *(pa.array((x - first[row]).astype(np.int32)) for x in (starts, ends)),
                *(pa.array(x.view(np.int64)) for x in (low, code)),
            ],
            ["_id", "_k", "_at", "_end", "_fp", "_code"],
        )


def _chains(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Matches of one document that go on side by side in both places, as one."""
    for batch in batches:
        rows = []
        for name, key, matches in zip(batch.column("_id").to_pylist(), batch.column("_k").to_pylist(), batch.column("_found").to_pylist()):
            chains: dict[tuple, list] = {}  # by source and distance: what goes on
            for m in sorted(matches, key=lambda m: m["at"]):
                line = (m["id"], m["k"], m["source"] - m["at"])
                known = chains.get(line)
                if known is not None and m["at"] <= known[3]:
                    known[3] = max(known[3], m["end"])
                    continue
                if known is not None:
                    rows.append(known)
                chains[line] = [name, key, m["at"], m["end"], m["id"], m["k"], m["source"]]
            rows += chains.values()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _extend(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Each match grows line by line to either side while both places say the same."""
    names = ["_id", "_k", "_from", "_to", "_source_id", "_source_k", "_source"]
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("_from", "_to", "_source")}
        for row in range(batch.num_rows):
            mine, theirs = (np.asarray(batch.column(c)[row].values) for c in ("_mine", "_theirs"))
            lo, hi, at = (columns[c][row] for c in ("_from", "_to", "_source"))
            on, back = 0, 0
            while on < reach and hi + on < len(mine) and at + hi - lo + on < len(theirs) and mine[hi + on] == theirs[at + hi - lo + on]:
                on += 1
            while back < reach and lo > back and at > back and mine[lo - back - 1] == theirs[at - back - 1]:
                back += 1
            for c, value in (("_from", lo - back), ("_to", hi + on), ("_source", at - back)):
                columns[c][row] = value
        grown = {c: pa.array(values, pa.int32()) for c, values in columns.items()}
        yield pa.RecordBatch.from_arrays([grown[c] if c in grown else batch.column(c) for c in names], names)


def repeats(lines: DataFrame, least_words: int = WORDS, least_lines: int = LINES) -> DataFrame:
    """(_id, _k, _from, _to, _source_id, _source_k, _source): runs of solid lines (numbered from 0, the end is not included) that say
    what an earlier document, or an earlier part of the same one, says from its line _source on. `lines` is a stored `line_table`.

    A match's maximal run has, beyond the windows that match themselves, at most `least_lines` less one lines on either side (or
    `least_words` less one), so it is extended by no more.
    """
    reach = max(0, min(least_words, least_lines) - 1)
    kind = lines.schema["_id"].dataType
    named = kind.simpleString()
    found = stored(
        lines.select("_id", "_k", "_lines").mapInArrow(
            lambda batches: _windows(batches, least_words, least_lines),
            f"_id {named}, _k long, _at int, _end int, _fp long, _code long",
        ),
        "line-windows",
    )
    # Stored sides of a join stand behind an exchange of their own, so that hot keys of the other side can be split.
    repeated = stored(found.groupBy("_fp").agg(F.count("*").alias("_n")).filter("_n > 1").select("_fp"), "line-repeated")
    place = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_k").alias("k"), F.col("_at").alias("at"))
    # The fingerprint and the code are hashes of the same lines by two functions: together 128 bits.
    windows = found.join(shuffled(repeated), "_fp", "left_semi").select("_fp", "_code", "_end", place.alias("_place"))
    earliest = windows.groupBy("_fp", "_code").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earliest = stored(earliest.filter("_n > 1").drop("_n"), "line-first")
    later = windows.join(shuffled(earliest), ["_fp", "_code"]).filter("_place > _first")
    match = F.struct("_place.at", F.col("_end").alias("end"), "_first.id", "_first.k", F.col("_first.at").alias("source"))
    by_doc = later.groupBy(F.col("_place.id").alias("_id"), F.col("_place.k").alias("_k")).agg(F.collect_set(match).alias("_found"))
    fields = [("_id", None), ("_k", pa.int64()), ("_from", pa.int32()), ("_to", pa.int32()), ("_source_id", None), ("_source_k", pa.int64()), ("_source", pa.int32())]
    arrow = pa.schema([(name, to_arrow_type(kind) if of is None else of) for name, of in fields])
    schema = f"_id {named}, _k long, _from int, _to int, _source_id {named}, _source_k long, _source int"
    chains = stored(by_doc.mapInArrow(lambda batches: _chains(batches, arrow), schema), "line-chains")
    known = lines.filter(F.size("_lines") > 0).select("_id", "_k", F.col("_lines.a").alias("_a")).dropDuplicates(["_id", "_k"])
    theirs = known.select(F.col("_id").alias("_x"), F.col("_k").alias("_y"), F.col("_a").alias("_theirs"))
    mine = known.select(F.col("_id").alias("_p"), F.col("_k").alias("_q"), F.col("_a").alias("_mine"))
    both = (
        chains.join(shuffled(stored(theirs, "line-theirs")), (F.col("_source_k") == F.col("_y")) & F.col("_source_id").eqNullSafe(F.col("_x")))
        .drop("_x", "_y")
        .join(shuffled(mine), (F.col("_k") == F.col("_q")) & F.col("_id").eqNullSafe(F.col("_p")))
        .drop("_p", "_q")
    )
    return both.mapInArrow(lambda batches: _extend(batches, reach), schema)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which lines of a document go, by their numbers among all lines."""
    for batch in batches:
        masks, gone = [], []
        for at, spans in zip(batch.column("_at"), batch.column("_spans").to_pylist()):
            at = np.asarray(at.values)
            change = np.zeros(len(at) + 1, np.int64)
            for span in spans:
                change[span["from"]] += 1
                change[span["to"]] -= 1
            out = np.cumsum(change[:-1]) > 0
            mask = np.zeros(int(at[-1]) + 1, bool)
            mask[at[out]] = True
            masks.append(mask.tolist())
            gone.append(int(out.sum()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in KEY), pa.array(masks, pa.list_(pa.bool_())), pa.array(gone, pa.int64())],
            [*KEY, "_mask", "_gone"],
        )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = WORDS, least_lines: int = LINES
) -> DataFrame:
    """For each row: _row (a struct of its other columns), kept text, number of solid lines, of those removed.

    Lines of white space only are passed over and stay; others are compared without white space at their ends. From each solid
    line on, a window reaches `least_words` words or `least_lines` lines. A window that also stands at an earlier place (at a
    smaller id, null first, or before it in the same document) goes, and so do the lines next to it that are the same as
    next to the earliest such place. Rows alike in id and text are treated alike, neither being earlier. Null texts stay
    null; an empty table gives an empty result.
    """
    lines = stored(line_table(docs, id_col, text_col), "lines")
    spans = repeats(lines, least_words, least_lines).groupBy(F.col("_id").alias("_name"), F.col("_k").alias("_code")).agg(
        F.collect_set(F.struct(F.col("_from").alias("from"), F.col("_to").alias("to"))).alias("_spans")
    )
    # Rows alike share their lines, so one of them is enough.
    places = lines.select("_id", *KEY, F.col("_lines.at").alias("_at"))
    masks = stored(
        places.join(shuffled(stored(spans, "line-spans")), (F.col("_k") == F.col("_code")) & F.col("_id").eqNullSafe(F.col("_name")))
        .select(*KEY, "_at", "_spans")
        .dropDuplicates(KEY)
        .mapInArrow(_masks, "_k long, _h long, _mask array<boolean>, _gone long"),
        "line-masks",
    )
    rows = docs.select(others(docs, text_col).alias("_row"), F.col(text_col).alias("_text"), *key_columns(id_col, text_col))
    stays = F.filter(_lines(F.col("_text")), lambda x, i: ~F.coalesce(F.get("_mask", i), F.lit(False)))
    solid = F.filter(_lines(F.col("_text")), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return rows.join(shuffled(masks), KEY, "left").select(
        "_row",
        F.when(F.col("_mask").isNull(), F.col("_text")).otherwise(F.array_join(stays, "\n")).alias("_text"),
        F.coalesce(F.size(solid), F.lit(0)).cast("long").alias("_lines"),
        F.coalesce("_gone", F.lit(0).cast("long")).alias("_removed"),
    )
