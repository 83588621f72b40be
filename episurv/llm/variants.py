"""Spelling variants by a variable-length gram index.

The gram dictionary is pruned by frequency: a gram that many words hold is extended by one letter more, up to the longest
length, a rarer one is not, as its list is short already. A word is decomposed into the longest gram of the dictionary at
each place, those inside an earlier one left out.

For each place where one letter may be inserted, deleted or replaced, the affected-gram table of a word says which of its grams
such an edit can touch: those that hold the place, those before it that could be extended over it, those behind it that an extended
gram could swallow. The bound of a word is its number of grams less the most affected ones; it is at least one, as two of the longest
grams fit into the shortest word. A near word holds all grams that its edit cannot touch: those before the place as far
from the start, those behind as far from the end. So, instead of counting single grams over their long lists, the lists of
the unaffected grams of each place are merged ahead: one index key stands for their intersection. Words that meet under a key
are candidates, and their edit distance decides.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import map_texts, stored

#: Letters of a word.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Shortest and longest gram; words that a gram may have before it is extended.
LEAST_GRAM, MOST_GRAM, FREQUENT = 2, 3, 100
#: Code points of a word; occurrences; how many times as often a form occurs.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10


def runs_of_letters(docs: DataFrame, text_col: str, *columns: str | Column) -> DataFrame:
    """`columns` and `run` for each maximal run of letters, A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(LETTERS), F.lit(0))
    return docs.select(*columns, F.explode(found).alias("run")).withColumn("run", F.translate("run", upper, upper.lower()))


def counted_words(runs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the column `word`; counts are combined in each task before they move."""
    words = runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, least: int = LEAST_GRAM, most: int = MOST_GRAM, frequent: int = FREQUENT) -> set[str]:
    """The grams that are extended: those of more than `frequent` words (a word with two of them counts twice), whose own
    beginning is extended too. There are at most alphabet ** (most - 1) of each length below `most`, which is 8,100 for
    pairs of these letters, and no more than places of grams in all words over `frequent`."""
    found: set[str] = set()
    for size in range(least, most):
        places = F.sequence(F.lit(1), F.length("word") - (size - 1))
        grams = words.filter(F.length("word") >= size).select(
            F.explode(F.transform(places, lambda p: F.substring(F.col("word"), p, F.lit(size)))).alias("gram")
        )
        counts = grams.groupBy("gram").count().filter(F.col("count") > frequent)
        level = {r["gram"] for r in counts.select("gram").collect()}
        found |= level if size == least else {g for g in level if g[:-1] in found}
    return found


def decompose(word: str, extended: Collection[str], least: int = LEAST_GRAM, most: int = MOST_GRAM) -> list[tuple[int, int]]:
    """Start and length of each gram, in order."""
    out, covered, n = [], 0, len(word)
    for start in range(n - least + 1):
        end = start + least
        while end < n and end - start < most and word[start:end] in extended:
            end += 1
        if end > covered:
            out.append((start, end - start))
            covered = end
    return out


def unaffected(grams: list[tuple[int, int]], places: int, gap: bool, most: int = MOST_GRAM) -> Iterator[tuple[int, int]]:
    """For each place of an edit, how many grams at the start and which first one at the end it cannot touch.

    A place is a letter (replaced or deleted) or, with `gap`, the gap before it (a letter inserted). A gram that begins
    `most` letters or more before the place ends before it, however far it is extended. One behind the place stays if it
    reaches beyond all grams that hold the place.
    """
    before, behind = 0, 0
    for place in range(places):
        while before < len(grams) and grams[before][0] <= place - most:
            before += 1
        first, reach = (place, place + most - 1) if gap else (place + 1, place + most)
        while behind < len(grams) and (grams[behind][0] < first or sum(grams[behind]) - 1 < reach):
            behind += 1
        yield before, behind


def gram_bound(grams: list[tuple[int, int]], length: int, most: int = MOST_GRAM) -> int:
    """Grams of a word that are left whatever one edit does: all but the most affected ones."""
    left = [b + len(grams) - e for gap in (False, True) for b, e in unaffected(grams, length + gap, gap, most)]
    return min(left)


def index_keys(word: str, extended: Collection[str], least: int = LEAST_GRAM, most: int = MOST_GRAM) -> tuple[set[int], set[int]]:
    """Keys of the merged lists: those of the word as the longer or equal one of two, and as the shorter one."""
    grams, n = decompose(word, extended, least, most), len(word)
    texts = [word[a : a + size] for a, size in grams]
    heads, tails = [""], [""]
    for text, (start, _) in zip(texts, grams):
        heads.append(f"{heads[-1]}{start} {text}|")
    for text, (start, _) in zip(reversed(texts), reversed(grams)):
        tails.append(f"{n - start} {text}|{tails[-1]}")
    out: tuple[set[int], set[int]] = (set(), set())
    for gap in (False, True):
        parts = {(b, len(grams) - e) for b, e in unaffected(grams, n + gap, gap, most)}
        for before, behind in parts:
            out[gap].add(xxhash.xxh3_64_intdigest(f"{n + gap}:{heads[before]}:{tails[behind]}"))
    return out


def gram_index(words: DataFrame, extended: Collection[str], least: int, most: int) -> DataFrame:
    """(key, shorter, word, n): each word under the merged lists of its grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                rows, keys, shorter = [], [], []
                for row, word in enumerate(part.column("word").to_pylist()):
                    for role, found in enumerate(index_keys(word, extended, least, most)):
                        keys.extend(found)
                        rows.extend([row] * len(found))
                        shorter.extend([role == 1] * len(found))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(keys, np.uint64).view(np.int64)),
                        pa.array(shorter, pa.bool_()),
                        part.column("word").take(at),
                        part.column("n").take(at),
                    ],
                    ["key", "shorter", "word", "n"],
                )

    return map_texts(words.select("word", "n"), run, "key long, shorter boolean, word string, n long")


def near_words(words: DataFrame, least: int = LEAST_GRAM, most: int = MOST_GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, other, other_n) of each two words one edit apart, once in each direction. `words` is a stored table."""
    index = stored(gram_index(words, frequent_grams(words, least, most, frequent), least, most), "gram-index")
    a = index.select("key", F.col("shorter").alias("_s"), F.col("word").alias("_a"), F.col("n").alias("_na"))
    b = index.filter("NOT shorter").select("key", F.col("word").alias("_b"), F.col("n").alias("_nb"))
    met = a.join(b, "key").filter(F.col("_s") | (F.col("_a") < F.col("_b")))
    links = met.filter(F.levenshtein("_a", "_b", 1) == 1).select("_a", "_na", "_b", "_nb").distinct()
    ways = [F.struct(*[F.col(c).alias(d) for c, d in zip(way, ("word", "n", "other", "other_n"))]) for way in (("_a", "_na", "_b", "_nb"), ("_b", "_nb", "_a", "_na"))]
    return links.select(F.inline(F.array(*ways)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Each round doubles the steps; forms lead to words that
    are several times as frequent, so there are no rings and the rounds grow with the logarithm of a logarithm of the counts."""
    at = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(at.join(further, "root", "left").select("word", "root", "_next"), "variant-steps")
        if not moved.filter("_next IS NOT NULL").limit(1).count():
            return at
        at = stored(moved.select("word", F.coalesce("_next", "root").alias("root")), "variant-roots")


def group_variants(
    words: DataFrame, factor: int = FACTOR, least: int = LEAST_GRAM, most: int = MOST_GRAM, frequent: int = FREQUENT
) -> DataFrame:
    """For each row of (word, n), words distinct and of at least 2 * most code points: word, n, n_near, form, form_n, root.

    Near words are one inserted, deleted or replaced code point apart. The form is the near word of the largest n, of several the
    first in code-point order, if it has at least `factor` times the word's n, else null. The root is where forms lead
    to, the word itself without a form. An empty table gives an empty result. A shorter word raises an error, as its
    bound could be zero.
    """
    rows = stored(words.select("word", "n"), "variant-words")
    shortest = rows.agg(F.min(F.length("word"))).first()[0]
    if shortest is not None and shortest < 2 * most:
        raise ValueError(f"words of {shortest} code points with grams of {most}")
    near = near_words(rows, least, most, frequent)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("_best")
    known = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = rows.join(known, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "_best"
    )
    has = -F.col("_best.less") >= factor * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", "n_near", F.when(has, F.col("_best.word")).alias("form"), F.when(has, -F.col("_best.less")).alias("form_n")
        ),
        "variant-forms",
    )
    last = roots(formed.filter("form IS NOT NULL"))
    return formed.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
