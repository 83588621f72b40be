"""Near copies of the pipeline stage next to all pairs by exact similarity."""

import random
import re

import numpy as np
import pytest
from test_corpus_rows import frame, odd_texts

import corpus_pipeline
from episurv.llm import minhash, simhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_stay(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}


def test_planted_copies_go(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, planted = odd_texts(), 0
    for share in (0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05) * 6:
        words = rng.choices(vocabulary, k=rng.randrange(250, 600))
        copy = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
        texts += [" ".join(words), " ".join(copy)]
        planted += 0.8 <= similarity(shingles(texts[-2]), shingles(texts[-1])) < 1
    chain = rng.choices(vocabulary, k=400)  # one group by links: neighbours are near copies, the ends are not
    for i in range(20):
        chain[i * 20] = f"new{i}"
        chain[i * 20 + 7] = f"new{i}"
        texts.append(" ".join(chain))
    assert planted > 15
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()}
    assert got == brute_stay(texts)


def test_rows_alike_leave_one(spark):
    df = frame(spark, ["a b c", "a b c", "a b c", "q r s t", None, None], ids=[4, 4, 9, None, None, None])
    rows = minhash.one_of_each(df).select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == [("4", "a b c"), ("None", "None"), ("None", "q r s t")]


@pytest.mark.parametrize("bucket", [1, 8, 64])
def test_boilerplate_and_copies(spark, bucket):
    """Texts that share most of their words without being near copies, and near copies among them."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared, texts = rng.choices(vocabulary, k=100), []
    for i in range(150):
        words = shared + rng.choices(vocabulary, k=rng.choice([8, 12, 25, 40]))
        texts.append(" ".join(words))
        if i % 10 == 0:
            words[rng.randrange(len(words))] = "other"
            texts.append(" ".join(words))
    got = {r["doc_id"] for r in minhash.one_of_each(frame(spark, texts), bucket=bucket).collect()}
    assert got == brute_stay(texts)


def test_odd_rows(spark):
    long = "word " * 30_000 + "end"
    texts = [None, "", " \t", "a", "A", long, long + " other", "x y", None]
    got = minhash.one_of_each(frame(spark, texts))
    assert got.columns == frame(spark, texts).columns
    assert {r["doc_id"] for r in got.collect()} == brute_stay(texts)
    assert minhash.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("share,least", [(0.004, 1.0), (0.015, 0.99), (0.02, 0.9)])
def test_recall(spark, share, least):
    """Pairs of similarity 0.8 to 0.95 that are caught, among as many that are less similar."""
    rng = random.Random(int(share * 1000))
    vocabulary, texts, alike = [f"w{i}" for i in range(9000)], [], []
    for i in range(150):
        words = rng.choices(vocabulary, k=300)
        copy = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
        texts += [" ".join(words), " ".join(copy)]
        alike.append(similarity(shingles(texts[-2]), shingles(texts[-1])) >= 0.8)
    got = {r["doc_id"] for r in minhash.one_of_each(frame(spark, texts), bucket=4).collect()}
    caught = [2 * i + 1 not in got for i in range(150)]
    assert sum(alike) > 60
    assert sum(c for c, a in zip(caught, alike) if a) >= least * sum(alike)
    assert not any(c for c, a in zip(caught, alike) if not a)


@pytest.mark.parametrize("size", [10, 5000])
def test_keys_do_not_depend_on_neighbours(size):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, size, 3, 4096, 1, size, 8192, 2)]
    alone = [minhash.band_keys([s])[0] for s in sets]
    assert (minhash.band_keys(sets) == np.array(alone)).all()


def test_sketches_rule_no_similar_pair_out():
    rng = np.random.default_rng(4)
    for n in (1, 5, 100, 3000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.r_[a[n // 10 :], rng.integers(0, 2**64, n // 10, dtype=np.uint64)]
        bits = int(np.bitwise_count((minhash.parity(a) ^ minhash.parity(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_pivots_link_before_bands(spark, monkeypatch):
    """Of texts whose digests are within two bits the pivot tables make a forest; bands compare none of them again."""
    rng = random.Random(12)
    vocabulary, texts = [f"w{i}" for i in range(5000)], ["", "a b", None]
    for i in range(40):
        words = rng.choices(vocabulary, k=500)
        texts.append(" ".join(words))
        for place in rng.sample(range(len(words)), i % 4):
            words[place] = "other"
            texts.append(" ".join(words))
    tables, keep = {}, minhash.stored

    def noted(df, name):
        tables.setdefault(name, []).append(keep(df, name))
        return tables[name][-1]

    monkeypatch.setattr(minhash, "stored", noted)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()}
    assert got == brute_stay(texts)

    sets = [s for s in minhash.shingle_sets([(t or "").encode() for t in texts]) if len(s)]
    prints = {minhash.xxhash.xxh3_128_digest(s.tobytes()): simhash.digest(s) for s in sets}

    def groups(pairs):
        root = {s: s for s in prints}
        for a, b in pairs:
            root = {s: root[a] if r == root[b] else r for s, r in root.items()}
        return {frozenset(s for s in prints if root[s] == r) for r in root.values()}

    close = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    links = [{(bytes(r["_a"]), bytes(r["_b"])) for r in t.collect()} for t in tables["near-links"]]
    assert len(close) > 15
    assert groups(links[0]) == groups(close)
    for t in tables["near-pairs"][1:]:
        assert not close & {(bytes(r["_a"]), bytes(r["_b"])) for r in t.collect()}


def test_digest_is_the_majority_of_bits():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 40_000):
        values = rng.integers(0, 2**64, n, dtype=np.uint64)
        ones = [int((values >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        assert simhash.digest(values) == sum(1 << b for b in range(64) if 2 * ones[b] > n)
