"""License scan: one Aho-Corasick automaton for notice phrases and identifier tags, a shunting-yard parser for expressions.

A text is reduced to its lower-cased words, one blank between them, and goes through the automaton once. What it finds is
a notice phrase, which carries a label, or the words of an identifier tag. Where a tag is found, the text behind each
tag is read as a licence expression: `and`, `or`, `with` and brackets go through the shunting yard into postfix order, whose
evaluation says whether the accepted licences suffice.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episurv.llm.common import alnum_words, map_texts, slices, text_bytes

#: Notice phrases that count as base places, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further phrases and their labels.
MORE_PHRASES = {
    "apache 2 0 license": "apache-2",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
    "the mit license": "mit",
    "the unlicense": "unlicense",
}
#: Words of the identifier tag, and the tag as it stands in a text.
TAG_WORDS = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
#: Identifiers of expressions whose label is that of a phrase.
ALIASES = {
    "apache-2.0": "apache-2",
    "cc-by-nc-4.0": "cc-by-nc",
    "gpl-2.0-only": "gpl-2",
    "gpl-3.0-only": "gpl-3",
}
#: Licences that an expression is evaluated with, unless others are given.
PERMISSIVE = ("mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "zlib", "0bsd")
#: How far a valid expression and a notice phrase are trusted.
TAG_WEIGHT, PHRASE_WEIGHT = 0.95, 0.8

_TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, in lower case; None if it is not well formed.

    `with` binds closer than `and`, `and` closer than `or`; all are left associative. Reading ends where an expression
    cannot go on (a comment's end, further prose), unless brackets are open.
    """
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True  # whether an operand comes next
    while m := _TOKEN.match(expression, at):
        word = (m[3] or m[1] or m[2]).lower()
        if operand:
            if word == "(":
                stack.append(word)
            elif word == ")" or word in _RANK:
                return None
            else:
                out.append(word.rstrip(".:"))
                operand = False
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        at = m.end()
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str], accepted: Collection[str], aliases: Mapping[str, str] = ALIASES) -> tuple[bool, list[str]] | None:
    """Whether the accepted licences suffice, and the labels the expression names; None where `with` joins other than a licence
    and an exception. An exception only permits more, so a licence accepted alone is accepted with it."""
    stack: list[tuple[bool, str | None]] = []  # value; label of a single licence
    labels: set[str] = set()
    for word in order:
        if word not in _RANK:
            label = aliases.get(word, word)
            stack.append((label in accepted, label))
            continue
        (right, exception), (left, licence) = stack.pop(), stack.pop()
        if word == "with":
            if licence is None or exception is None:
                return None
            both = f"{licence}-with-{exception}"
            labels.add(both)
            stack.append((left or both in accepted, None))
            continue
        labels.update(x for x in (licence, exception) if x is not None)
        stack.append((left and right if word == "and" else left or right, None))
    value, single = stack.pop()
    if single is not None:
        labels.add(single)
    return value, sorted(labels)


class Scanner:
    """The automaton over words. Patterns begin and end with a blank, so that they match whole words only."""

    def __init__(self, base: Mapping[str, str], more: Mapping[str, str], accepted: Collection[str]):
        import ahocorasick

        self.accepted, self.automaton = frozenset(accepted), ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, phrases in (("base", base), ("phrase", more), ("tag", {TAG_WORDS: ""})):
            for phrase, label in phrases.items():
                words = alnum_words(phrase.encode())
                if words:
                    entries.setdefault(b" ".join(words).decode("latin-1"), []).append((kind, label, len(words)))
        for phrase, values in entries.items():
            self.automaton.add_word(f" {phrase} ", values)
        if entries:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[dict], list[dict]]:
        """Number of words, spans of phrases in word positions, expressions behind tags."""
        words = alnum_words(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        spans, tagged, seen, count = [], False, 0, 0
        for end, values in self.automaton.iter(line) if words and len(self.automaton) else ():
            count += line.count(" ", seen, end)  # blanks before the one that ends the phrase: words so far
            seen = end
            for kind, label, size in values:
                if kind == "tag":
                    tagged = True
                else:
                    spans.append({"kind": kind, "label": label, "first": count - size, "words": size})
        return len(words), spans, self.expressions(text) if tagged else []

    def expressions(self, text: bytes) -> list[dict]:
        out = []
        for m in _TAG.finditer(text.decode()):
            order = postfix(m[1])
            value = evaluate(order, self.accepted) if order else None
            accepted, labels = value or (None, [])
            out.append({"text": m[1], "postfix": order or [], "accepted": accepted, "labels": labels})
        return out


_SPAN = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
_EXPRESSION = pa.struct(
    [("text", pa.string()), ("postfix", pa.list_(pa.string())), ("accepted", pa.bool_()), ("labels", pa.list_(pa.string()))]
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Mapping[str, str] | None = None,
    more: Mapping[str, str] | None = None,
    accepted: Collection[str] = PERMISSIVE,
) -> DataFrame:
    """For each row: id, n_words, spans (kind base or phrase, label, first word, words), expressions (text, postfix, accepted:
    whether the accepted licences suffice, null if not well formed; labels), labels (all, sorted), score.

    The score is 0 without a label, else 1 less the product of what each label's best evidence leaves open. Null texts count
    as empty. Overlapping phrases are all found. Rows are scanned one by one, whole texts: repeated rows alike, an empty table
    gives an empty result. Other columns are not read.
    """
    base = dict(BASE_PHRASES if base is None else base)
    more = dict(MORE_PHRASES if more is None else more)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more, accepted)
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [scanner.scan(text) for text in text_bytes(part.column("_text"))]
                labels, scores = [], []
                for _, spans, expressions in found:
                    weight = {s["label"]: PHRASE_WEIGHT for s in spans}
                    weight |= {label: TAG_WEIGHT for e in expressions for label in e["labels"]}
                    left = 1.0
                    for label in weight:
                        left *= 1 - weight[label]
                    labels.append(sorted(weight))
                    scores.append(round(1 - left, 6))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.list_(_SPAN)),
                        pa.array([f[2] for f in found], pa.list_(_EXPRESSION)),
                        pa.array(labels, pa.list_(pa.string())),
                        pa.array(scores, pa.float64()),
                    ],
                    [id_col, "n_words", "spans", "expressions", "labels", "score"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_words long, spans array<struct<kind:string,label:string,first:long,words:long>>, "
        "expressions array<struct<text:string,postfix:array<string>,accepted:boolean,labels:array<string>>>, "
        "labels array<string>, score double"
    )
    return map_texts(rows, run, schema)
