"""Token alignment, spelling variants and license scans next to brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_corpus_rows import alnum, by_id, frame, odd_texts
from tokenizers import Tokenizer

from episurv.llm import alignment, licenses, queries, variants


def written(spark, texts, scratch, ids=None):
    """A folder with these documents, for the registered queries."""
    frame(spark, texts, ids).write.parquet(f"{scratch}/documents.parquet")
    return scratch


# ---- alignment --------------------------------------------------------------------------------

A_FILE, B_FILE = alignment.default_files()


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        parts_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        pieces = map(b.id_to_piece, ids_b)
        parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        return (ids_a, parts_a), (ids_b, parts_b)

    return both


def brute_alignment(texts, both):
    docs, counts = [], Counter()
    for text in texts:
        doc = {"n_a": 0, "n_b": 0, "groups": [], "links": []}
        if text:
            (a, pa), (b, pb) = both(text)
            if b"".join(pa) == b"".join(pb) == b" " + text.encode():
                ends_a = {e: i for i, e in enumerate(np.cumsum([len(p) for p in pa]).tolist())}
                ends_b = {e: i for i, e in enumerate(np.cumsum([len(p) for p in pb]).tolist())}
                i = j = 0
                for end in sorted(ends_a.keys() & ends_b.keys()):
                    x, y = ends_a[end] + 1, ends_b[end] + 1
                    doc["groups"].append((a[i:x], b[j:y]))
                    doc["links"].append((a[x - 1], b[y - 1]))
                    i, j = x, y
                doc["n_a"], doc["n_b"] = len(a), len(b)
                counts.update(doc["links"])
        docs.append(doc)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for d in docs:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in d["groups"])
        out.append((
            d["n_a"], d["n_b"], len(d["groups"]), len(d["links"]), sum(counts[x] == best[x[1]] for x in d["links"]),
            sum(counts[x] for x in d["links"]), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


def test_alignment(spark, scratch, tokens):
    texts = [*odd_texts()[:40], "a ▁ b", "x<|endoftext|>y", "</s> <s>[INST]", "\x00", " two  spaces ", "①②é ﬁ 日本語テキスト\n\n\tend", "▁", "ab" * 3000]
    found = queries.op11_token_alignment(spark, written(spark, texts, scratch))
    got = by_id(found, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = brute_alignment(texts, tokens)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[2] < w[0] for w in want) > 20 and want[40] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_nothing(spark, scratch):
    assert queries.op11_token_alignment(spark, written(spark, [], scratch)).count() == 0


@pytest.mark.parametrize("n,m", [(0, 5), (5, 0), (1, 1), (63, 1000), (64, 64), (65, 65), (500, 40_000), (3000, 3100)])
def test_gallop(n, m):
    rng = np.random.default_rng(n + m)
    short, long = (np.sort(rng.choice(max(n, m) * 3 + 1, size, replace=False)) for size in (n, m))
    i, j = alignment.gallop(short, long)
    want, x, y = np.intersect1d(short, long, return_indices=True)
    assert (i == x).all() and (j == y).all() and (short[i] == want).all()


def test_links_are_within_the_bound(tokens):
    a, b = alignment.ByteTokens(A_FILE).bytes_of, alignment.PieceTokens(B_FILE).bytes_of
    pairs = set()
    for text in odd_texts()[8:30]:
        (ids_a, _), (ids_b, _) = tokens(text)
        pairs |= {(x, y) for d in brute_alignment([text], tokens) for x, y in zip(ids_a, ids_b) if a[x].endswith(b[y]) or b[y].endswith(a[x])}
    assert pairs and len(pairs) < alignment.pair_bound() < 1_000_000


# ---- spelling variants ------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute_variants(words, factor=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def spelled(rng, n):
    return "".join(rng.choice(["the", "er", "in", "tion", "é", "ÿ", "o", "un", "ß"]) for _ in range(n))


def misspelled(rng, word):
    at = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    letter = rng.choice("aetionÀé")
    return word[:at] + letter * (kind < 2) + word[at + (kind > 0) :]


def variant_texts(seed=3):
    rng = random.Random(seed)
    stock = [spelled(rng, rng.randrange(3, 6)) for _ in range(60)]
    common = stock[:8] + [misspelled(rng, w) for w in stock[:8]]
    texts = [None, "", "Short x", "A" * 5000 + " " + "a" * 5000, "ÀÈÌÒÙàèìòù ÀÈÌÒÙàèìòù"]
    texts.append("chaining " * 400 + "chaininx " * 22 + "chaininxy " * 2)  # a form whose form is another
    for _ in range(80):
        words = rng.choices(stock, k=20) + rng.choices(common, k=60) + [misspelled(rng, rng.choice(stock)) for _ in range(8)]
        words += ["theering"] * 3 + ["THEERING", "theerxng", "theering_theerin"]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("frequent", [0, 5, 100, 10**9])
def test_variants(spark, frequent):
    words = brute_words(enumerate(variant_texts()))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = variants.group_variants(df.selectExpr("word", "n", "'x' AS form", "'y' AS key"), frequent=frequent)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}
    want = brute_variants(words)
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 5 and any(r != f for f, r, *_ in want.values() if f)


def test_variant_query(spark, scratch):
    texts = variant_texts(8)
    ids = [None, *range(7, 6 + len(texts))]
    found = queries.op12_spelling_variants(spark, written(spark, texts, scratch, ids))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}
    assert got == brute_variants(brute_words(zip(ids, texts)))


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], "word string, n long")
    assert variants.group_variants(df).columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert variants.group_variants(df).count() == 0


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        variants.group_variants(spark.createDataFrame([("abcde", 2)], "word string, n long"))


def test_affected_grams():
    """What the table leaves of a word's grams is left after every edit, and never nothing."""
    rng = random.Random(4)
    alphabet = "abc"
    for _ in range(300):
        extended = {a + b for a in alphabet for b in alphabet if rng.random() < 0.5}
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 12)))
        n = len(word)
        assert variants.gram_bound(variants.decompose(word, extended), n) >= 1
        longer, _ = variants.index_keys(word, extended)
        edits = {word[:i] + c + word[i + 1 :] for i in range(n) for c in alphabet} - {word}
        edits |= {word[:i] + word[i + 1 :] for i in range(n)} if n > 7 else set()
        for other in edits:
            theirs = variants.index_keys(other, extended)[len(other) < n]
            assert longer & theirs, (word, other)


# ---- license scans ----------------------------------------------------------------------------


def brute_places(words, phrases):
    return [(i, label) for p, label in phrases.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]


LICENSED = [
    None,
    "",
    "Released UNDER the MIT-License. Apache License, Version 2.0; apache license version 2",
    "under the mit license under the mit license",
    "CC BY-NC-SA 4.0, cc by nc",
    "undr the mit license, under the mit licenses, under the\nmit\tlicense",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nrest",
    "# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 */",
    "SPDX-License-Identifier: MIT AND (ISC\nSPDX-License-Identifier: Zlib -->",
    "SPDX License Identifier without an expression",
    "x " * 5000 + "under the mit license",
    "GNU General Public License version 3, version 2",
]


def test_scan(spark, scratch):
    texts = [*LICENSED, *odd_texts()[:20]]
    rows = queries.op13_license_scan(spark, written(spark, texts, scratch)).collect()
    got = {r["doc_id"]: r.asDict() for r in rows}
    for i, text in enumerate(texts):
        words, row = alnum(text), got[i]
        places = brute_places(words, licenses.BASE_PHRASES)
        assert row["n_words"] == len(words) and row["n_base"] == len(places)
        starts = [p for p, _ in places]
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        base = {label for _, label in places}
        assert row["base_labels"] == ",".join(sorted(base))
        more = base | {label for _, label in brute_places(words, licenses.MORE_PHRASES)}
        assert more <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])
    assert got[6]["labels"] == "apache-2,bsd-3-clause,mit"
    assert got[7]["labels"] == "gpl-2-with-classpath-exception-2.0"
    assert got[8]["labels"] == "zlib"
    assert got[9]["labels"] == ""


def test_scan_of_nothing(spark, scratch):
    assert queries.op13_license_scan(spark, written(spark, [], scratch)).count() == 0


@pytest.mark.parametrize(
    "text,order",
    [
        ("MIT", ["mit"]),
        ("a OR b AND c", ["a", "b", "c", "and", "or"]),
        ("(a OR b) AND c", ["a", "b", "or", "c", "and"]),
        ("a with e and b", ["a", "e", "with", "b", "and"]),
        ("a and b or c and d", ["a", "b", "and", "c", "d", "and", "or"]),
        ("a or b or c", ["a", "b", "or", "c", "or"]),
        ("GPL-2.0+ */", ["gpl-2.0+"]),
        ("((a))", ["a"]),
        ("a)", ["a"]),
        ("(a", None),
        ("a and", None),
        ("and a", None),
        ("()", None),
        ("", None),
    ],
)
def test_postfix(text, order):
    assert licenses.postfix(text) == order


def test_evaluate_against_python():
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice("abcdef")
        return f"({made(depth - 1)} {rng.choice(['and', 'or'])} {made(depth - 1)})"

    for _ in range(300):
        parts = [made(3) for _ in range(3)]
        text = f"{parts[0]} {rng.choice(['and', 'or'])} {parts[1]} {rng.choice(['and', 'or'])} {parts[2]}"
        accepted = {c for c in "abcdef" if rng.random() < 0.5}
        want = eval(text, {c: c in accepted for c in "abcdef"})
        value, labels = licenses.evaluate(licenses.postfix(text), accepted)
        assert value == want and labels == sorted(set(re.findall(r"\b[a-f]\b", text)))


def test_exceptions():
    def run(text, accepted):
        return licenses.evaluate(licenses.postfix(text), accepted)

    assert run("gpl with e", {"gpl-with-e"}) == (True, ["gpl-with-e"])
    assert run("gpl with e", {"gpl"}) == (True, ["gpl-with-e"])
    assert run("gpl with e or mit", set()) == (False, ["gpl-with-e", "mit"])
    assert run("(gpl or mit) with e", {"gpl"}) is None


def test_vocabulary_files_are_where_they_are_said_to_be():
    assert A_FILE == public_tokenizers.path("byte_bpe_50k.json")
