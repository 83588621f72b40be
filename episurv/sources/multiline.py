"""Delimited files whose records span lines, read in splits.

Whether a line begins a record depends on all quotes before it. Each line is therefore taken as a function: whether a quoted
field is open behind it, if none was open before it, and if one was. Such functions are composed in line order within each split
of a file and then over the splits of the file, which are few; what is open at the start of every split, and so of every line,
follows. Lines that are a record each pass on; only lines of longer records are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episurv.sources.delimited import OPTIONS, YEAR_PATTERN, scan_delimited, union_years, year_glob

#: Bytes of whole splits that one record may reach over.
MOST_BYTES = 256 << 20
#: Options of a file, not of a record.
_OF_FILES = ("header", "encoding", "multiLine", "inferSchema", "lineSep")


def open_after(line: Column, before: bool, sep: str, quote: str) -> Column:
    """Whether a quoted field is open behind a line, by whether one is open before it.

    The line is cut at its quotes. States, each behind a quote: 1 within a field without quotes, where quotes are text; 2 a quoted
    field was opened, or goes on after an escaped quote; 3 a quoted field was closed, or its escaped quote begins. The last part has
    no quote behind it, so 3 at the end means that the field is still open.
    """

    def step(state: Column, part: Column) -> Column:
        return (
            F.when(state == 2, 3)
            .when(part == "", F.when(state == 1, 1).otherwise(2))
            .when(part.endswith(sep), 2)
            .otherwise(1)
        )

    state = F.aggregate(F.split(line, re.escape(quote), -1), F.lit(2 if before else 0), step)
    return F.when(line.contains(quote), state == 3).otherwise(F.lit(before))


def _lines(spark: SparkSession, path: str, sep: str, quote: str, encoding: str) -> DataFrame:
    """(_file, _block, _at, _line, _closed, _open): each line with its split, its order there, and what is open behind it
    where nothing, and where a quoted field, is open before it."""
    text = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        text = F.decode(text.cast("binary"), encoding)
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        text.alias("_text"),
    )
    line = F.when(F.endswith("_text", F.lit("\r")), F.col("_text").substr(F.lit(1), F.length("_text") - 1)).otherwise(F.col("_text"))
    return raw.withColumn("_line", line).select(
        "_file",
        "_block",
        "_at",
        "_line",
        open_after(F.col("_line"), False, sep, quote).alias("_closed"),
        open_after(F.col("_line"), True, sep, quote).alias("_open"),
    )


def _composed(rows: DataFrame, window, closed: str, opened: str) -> DataFrame:
    """`_last` and `_swaps`, running: the last row that ends alike whatever is before it, with the number of rows up to it that
    turn open into closed and back; the number of such rows so far. `_behind` reads the composition from them."""
    turns = F.col(closed) & ~F.col(opened)
    fixed = F.when(F.col(closed) == F.col(opened), F.struct(F.col(closed).alias("open"), F.col("_swaps").alias("swaps")))
    return rows.withColumn("_swaps", F.sum(turns.cast("long")).over(window)).withColumn(
        "_last", F.last(fixed, ignorenulls=True).over(window)
    )


def _behind(before: Column) -> Column:
    turned = (F.col("_swaps") - F.coalesce("_last.swaps", F.lit(0))) % 2 == 1
    return F.coalesce(F.col("_last.open"), before) != turned


def _running(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks(lines: DataFrame, most_bytes: int) -> DataFrame:
    """(_file, _block, _entry, _exit, _owner, _header): for each split whether a quoted field is open at its start and at its end,
    the split in which the record open at its start began, whether the first line of the file that is not blank is in it."""
    narrow = lines.select("_file", "_block", "_at", "_closed", "_open", (F.col("_line") != "").alias("_solid"))
    within = _composed(narrow, _running("_file", "_block", order="_at"), "_closed", "_open")
    # A record begins behind each line that leaves nothing open, but for the last line of the split.
    ends = within.select(
        "_file", "_block", "_at", "_solid", _behind(F.lit(False)).alias("_c"), _behind(F.lit(True)).alias("_o")
    )
    first_end, last_at = F.min(F.when(~F.col("_o"), F.col("_at"))), F.max("_at")
    each = ends.groupBy("_file", "_block").agg(
        F.max_by("_c", "_at").alias("_closed"),
        F.max_by("_o", "_at").alias("_open"),
        F.coalesce(first_end < last_at, F.lit(False)).alias("_starts"),
        F.bool_or("_solid").alias("_solid"),
    )
    ordered = _running("_file", order="_block")
    by_file = Window.partitionBy("_file").orderBy("_block")
    known = _composed(each, ordered, "_closed", "_open").withColumn("_exit", _behind(F.lit(False)))
    known = known.withColumn("_entry", F.lag("_exit", 1, False).over(by_file))
    starts = F.when(~F.col("_entry") | F.col("_starts"), F.col("_block"))
    owner = F.last(starts, ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(F.col("_solid"), F.col("_block"))).over(Window.partitionBy("_file"))
    too_long = F.raise_error(F.concat(F.lit("a record without an end in "), F.col("_file"))).cast("long")
    return known.withColumn("_owner", owner).select(
        "_file",
        "_block",
        "_entry",
        "_exit",
        F.when(F.col("_entry") & (F.col("_block") - F.col("_owner") > most_bytes), too_long).otherwise(F.col("_owner")).alias("_owner"),
        (F.col("_block") == first).alias("_header"),
    )


def scan_records(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    source_col: str | None = None,
    most_bytes: int = MOST_BYTES,
    **options: str,
) -> DataFrame:
    """Every field as text, as `scan_delimited` gives it, but a file is read in splits although its records may span lines.

    Lines move once, to the task of their split; those of records that cross its ends once more. `source_col` names a column for the file of a record. Lines end with a line
    feed, also inside quotes; a carriage return before it is left out. Blank lines between records are left out, and the
    first record of each file where `header` is true. Short records have nulls at their end. A record that reaches over whole splits of more
    than `most_bytes` (a quote that is never closed) raises an error instead of filling one task. Quotes are escaped by doubling, the
    separator is not empty, and the encoding keeps line feeds as single bytes; other options raise an error.
    """
    chosen = {**OPTIONS, **options}
    sep, quote, encoding = chosen["sep"], chosen["quote"], chosen["encoding"]
    if chosen["escape"] != quote or len(quote) != 1 or not sep or encoding.upper().startswith(("UTF-16", "UTF-32")):
        raise ValueError("records are split for doubled quotes and encodings of single-byte line feeds only")
    if columns is None:
        columns = scan_delimited(spark, path, **options).columns
    lines = _lines(spark, path, sep, quote, encoding)
    within = _running("_file", "_block", order="_at")
    whole = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = _composed(lines.join(_blocks(lines, most_bytes), ["_file", "_block"]), within, "_closed", "_open")
    placed = placed.withColumn("_after", _behind(F.col("_entry")))
    previous = F.lag("_after").over(Window.partitionBy("_file", "_block").orderBy("_at"))
    placed = placed.withColumn("_before", F.coalesce(previous, F.col("_entry")))
    placed = placed.withColumn("_record", F.last(F.when(~F.col("_before"), F.col("_at")), ignorenulls=True).over(within))
    first = F.min(F.when(~F.col("_before") & (F.col("_line") != ""), F.col("_at"))).over(whole)
    placed = placed.withColumns({"_first": first, "_tail": F.max("_record").over(whole)})
    # Of the records of a split, the one open at its start and the one open at its end share their key with other splits.
    crosses = F.col("_record").isNull() | (F.col("_exit") & (F.col("_record") == F.col("_tail")))
    with_header = chosen["header"].lower() == "true"
    placed = placed.select(
        "_file",
        "_block",
        "_at",
        "_line",
        (~F.col("_before") & ~F.col("_after")).alias("_single"),
        F.when(F.col("_record").isNull(), F.col("_owner")).otherwise(F.col("_block")).alias("_home"),
        F.when(crosses, -1).otherwise(F.col("_record")).alias("_key"),
        F.coalesce(F.lit(with_header) & F.col("_header") & (F.col("_record") == F.col("_first")), F.lit(False)).alias("_named"),
    )
    single = placed.filter("_single AND NOT _named AND _line <> ''").select("_file", F.col("_line").alias("_text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "_line"))), lambda x: x["_line"])
    gathered = (F.bool_or("_named").alias("_named"), F.array_join(parts, "\n").alias("_text"))
    longer = placed.filter("NOT _single")
    # Lines of a split are together already: only records that cross its ends move again.
    inside = longer.filter("_key >= 0").groupBy("_file", "_block", "_key").agg(*gathered)
    across = longer.filter("_key < 0").groupBy("_file", "_home").agg(*gathered)
    records = single
    for part in (inside, across):
        records = records.unionByName(part.filter("NOT _named").select("_file", "_text"))
    parsing = {name: value for name, value in chosen.items() if name not in _OF_FILES}
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    fields = F.from_csv("_text", ", ".join(f"{c} string" for c in quoted), parsing)
    kept = [F.col(f"_fields.{c}") for c in quoted]
    if source_col:
        kept.append(F.col("_file").alias(source_col))
    return records.select("_file", fields.alias("_fields")).select(*kept)


def ingest_records(
    spark: SparkSession, directory: str, years: Sequence[int], pattern: str = YEAR_PATTERN, **options: str
) -> DataFrame:
    """The bronze table as `ingest` gives it, from files read in splits."""
    parts = []
    for year in years:
        records = scan_records(spark, year_glob(directory, year, pattern), source_col="_source_file", **options)
        added = {"ANO_DADOS": F.lit(year), "_ingested_at": F.current_timestamp()}
        fields = [c for c in records.columns if c != "_source_file"]
        parts.append(records.withColumns(added).select(*fields, *added, "_source_file"))
    return union_years(parts)
