"""Corpus operators on rows that break things, next to brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from episurv.llm import chat, decontaminate, exact, html, language, lines, packing, shards, simhash, substrings

#: Columns whose names operators use inside.
CLASHES = ["_id", "_k", "_h", "_text", "_row", "_fp", "_norm", "_size", "count", "n_words", "shard", "fingerprint", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def frame(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, f"s{n % 3}", len(t or ""), *["x"] * len(CLASHES)) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sentence(rng, n, words=40):
    return " ".join(rng.choice(["w", "ä", "Zz"]) + str(rng.randrange(words)) for _ in range(n))


def odd_texts(seed=1):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, shared passages."""
    rng = random.Random(seed)
    shared = [sentence(rng, 60) for _ in range(4)]
    texts = [None, None, "", " \t\n", "a", "a", "...", "日本 語", sentence(rng, 9000)]
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(1, 80)), rng.choice(shared), sentence(rng, rng.randrange(1, 30))]
        rng.shuffle(parts)
        texts.append("\n".join(parts[: rng.randrange(1, 4)]))
    texts += [shared[0], shared[0], shared[1] + " \x85 " + shared[2], texts[12], texts[12] + " ", texts[13].replace(" ", "  ")]
    return texts


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


# ---- decontamination --------------------------------------------------------------------------


def alnum(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(texts, items, length):
    phrases = defaultdict(set)
    for name, text in items:
        words = alnum(text)
        for i in range(max(1, len(words) - length + 1) if words else 0):
            phrases[tuple(words[i : i + length])].add(name)
    out = []
    for text in texts:
        words, hit, names = alnum(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if (owners := phrases.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= owners
        out.append((len(words), len(hit), sorted(str(n) for n in names if n is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_contamination(spark, block_bytes):
    rng, texts = random.Random(5), odd_texts()
    items = [(n, " ".join(alnum(t)[k : k + rng.randrange(3, 30)])) for n, t in enumerate(texts[9:40]) for k in (0, 7)]
    items += [(100, "A!"), (101, None), (102, ""), (None, "w1 w2"), (7, "w3 w4 w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(
        decontaminate.contamination_report(frame(spark, texts), bench, block_bytes=block_bytes), "n_words", "n_hit", "items"
    )
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items, 10)


def test_no_text_is_written_between_blocks(spark, monkeypatch):
    rng, texts, written = random.Random(5), odd_texts(), []
    items = [(n, " ".join(alnum(t)[k : k + 25])) for n, t in enumerate(texts[9:40]) for k in (0, 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = [bench.filter(f"item_id % 26 = {i % 26} AND hash(text) % 2 = {i // 26}").selectExpr("CAST(item_id AS STRING) AS _item", "text AS _t") for i in range(52)]
    rest = bench.filter("hash(text) % 2 < 0").selectExpr("CAST(item_id AS STRING) AS _item", "text AS _t")
    monkeypatch.setattr(decontaminate, "_blocks", lambda *a: [*parts, rest])
    stored = decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    found = decontaminate.contamination_report(frame(spark, texts), bench)
    got = by_id(found, "n_words", "n_hit", "items")
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items, 10)
    between = [columns for name, columns in written if name == "contamination"]
    assert len(between) >= 50 and not any("_text" in c or "_row" in c for c in between)


def test_pieces_have_all_phrases():
    rng = random.Random(8)
    for n in (0, 1, 9, 10, 11, 300):
        text = sentence(rng, n)
        pieces = list(decontaminate._pieces(text.encode(), 10, 64))
        parts = [alnum(p.decode()) for p in pieces]
        windows = {tuple(p[i : i + 10]) for p in parts for i in range(max(1, len(p) - 9))}
        words = alnum(text)
        assert windows - {()} == {tuple(words[i : i + 10]) for i in range(max(1, n - 9))} - {()}
        assert n < 300 or len(parts) > 10


def test_long_benchmark_without_a_word(spark):
    bench = spark.createDataFrame([(1, "." * 900), (1, "." * 900)], "item_id long, text string")
    got = by_id(decontaminate.contamination_report(frame(spark, ["a b", None]), bench, block_bytes=600), "n_words", "n_hit")
    assert got == {0: (2, 0), 1: (0, 0)}


def test_cut_texts(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [f"Before, {item.title()}! After.", item, "nothing here", None, "", f"{item} {item} x"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.decontaminate(frame(spark, texts), bench)
    got = {r["_row"]["doc_id"]: r["_text"] for r in left.collect()}
    assert got == {0: "Before, ! After.", 2: "nothing here", 3: None, 4: "", 5: " x"}
    assert decontaminate.decontaminate(frame(spark, texts), bench.limit(0)).count() == len(texts)


def test_cut_texts_in_batches_without_a_hit(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        docs = frame(spark, ["nothing here", f"a {item}", None, f"{item} b", "c"]).coalesce(1)
        got = {r["_row"]["doc_id"]: r["_text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {0: "nothing here", 1: "a ", 2: None, 3: " b", 4: "c"}


def test_index_against_plain_search():
    rng = np.random.default_rng(3)
    text = np.r_[0, rng.integers(0, 4, 3000), 0]
    index = decontaminate.FMIndex(text)
    phrases = np.zeros((300, 6), np.int64)
    lengths = rng.integers(1, 7, 300)
    for i, n in enumerate(lengths):
        phrases[i, :n] = rng.integers(1, 4, n)
    found, low, high = index.search(phrases, lengths)
    rows = dict(zip(found.tolist(), zip(low, high)))
    for i, n in enumerate(lengths):
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == phrases[i, :n]).all()]
        a, b = rows.get(i, (0, 0))
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- repeated word sequences ------------------------------------------------------------------


def brute_substrings(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window,hot", [(35, 20_000), (35, 2), (5, 3), (1, 20_000)])
def test_substrings(spark, window, hot):
    texts = odd_texts()
    got = by_id(substrings.dedup_substrings(frame(spark, texts), window=window, hot=hot), "n_words", "n_removed", "kept")
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, window)


def test_substrings_of_repeated_rows(spark):
    text = sentence(random.Random(2), 50)
    rows = substrings.dedup_substrings(frame(spark, [text, text, None, None], ids=[5, 5, None, None])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (50, 50), (50, 50)]


# ---- lines ------------------------------------------------------------------------------------


def brute_lines(texts, words=50, lines_of=4):
    """Number of solid lines, of those removed, kept text; texts stand in the order of their ids."""
    solid = [[(i, s) for i, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\n\x0b\f\r"))] for t in texts]
    first, reach = {}, min(words, lines_of) - 1

    def window(rows, i):
        total = 0
        for j in range(i, len(rows)):
            total += len(re.findall(r"[^\x20\x09-\x0D]+", rows[j][1]))
            if total >= words or j - i + 1 >= lines_of:
                return tuple(s for _, s in rows[i : j + 1])
        return None

    def alike(a, b, x, y, step):
        n = 0
        while n < reach and 0 <= x < len(a) and 0 <= y < len(b) and a[x][1] == b[y][1]:
            n, x, y = n + 1, x + step, y + step
        return n

    out = []
    for doc, (rows, text) in enumerate(zip(solid, texts)):
        gone = set()
        for i in range(len(rows)):
            if (run := window(rows, i)) is None:
                continue
            where, k = first.setdefault(run, (doc, i))
            if (where, k) != (doc, i):
                other, size = solid[where], len(run)
                lo, hi = i - alike(rows, other, i - 1, k - 1, -1), i + size + alike(rows, other, i + size, k + size, 1)
                gone.update(range(lo, hi))
        drop = {rows[i][0] for i in gone}
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
        out.append((len(rows), len(gone), kept))
    return out


@pytest.mark.parametrize("words,lines_of", [(50, 4), (5, 3), (1, 1), (9, 100), (1000, 2)])
def test_lines(spark, words, lines_of):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "\x0b", "one", "a line of six words each"]
    texts = [None, "", "\n\n", "a"] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(80)]
    texts += [" x \n" * 30, texts[9], "\n ".join(f"line {i}" for i in range(12)), "\n".join(f"line {i}" for i in range(12))]
    passage = sentence(rng, 60)
    texts += [f"own {i}\n{passage}\n{'tail' if i % 2 else 'end'}\nlast {i}" for i in range(4)]
    found = lines.dedup_lines(frame(spark, texts), least_words=words, least_lines=lines_of)
    got = {r["_row"]["doc_id"]: (r["_lines"], r["_removed"], r["_text"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, words, lines_of)
    if words == 50:
        assert [got[len(texts) - k][1] for k in (4, 3, 2, 1)] == [0, 1, 2, 1]  # the second tail stands apart from its like


# ---- near duplicates --------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    texts = odd_texts()
    texts += [texts[8] + " more", texts[8] + " and more", "One two", "ONE  two"]
    got = by_id(simhash.near_duplicates(frame(spark, texts)), "fingerprint", "component_id")
    prints = [brute_simhash(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i][1] for i in range(len(texts))] == brute_components(prints)
    stay = {r["doc_id"] for r in simhash.one_of_each(frame(spark, texts)).collect()}
    assert stay == set(brute_components(prints))


def test_one_of_rows_alike(spark):
    df = frame(spark, ["a b c", "a b c", "a b c", "q r s t", None, None], ids=[4, 4, 9, None, None, None])
    rows = simhash.one_of_each(df).select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == [("4", "a b c"), ("None", "None"), ("None", "q r s t")]


@pytest.mark.parametrize("small,large,split,held", [(32, 8192, 1024, 1 << 20), (2, 8192, 3, 5), (2, 4, 1 << 20, 1)])
def test_links_of_dense_fingerprints(spark, monkeypatch, small, large, split, held):
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    monkeypatch.setattr(simhash, "HELD_LINKS", held)
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, 1, 7, 2**64 - 1}
    for p in list(prints):
        for _ in range(20):
            prints.add(p := p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "_fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.similar_fingerprints(df, split)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    got, want = defaultdict(set), defaultdict(set)
    for s, r in zip(signed, brute_components(prints)):
        got[roots.get(s, s)].add(s)
        want[r].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "_a long, _b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 301)}, 501: 500}


# ---- exact duplicates -------------------------------------------------------------------------


def test_exact_groups(spark):
    texts = odd_texts() + ["x y", "xy ", "x\x0by\t\t", "x\xa0y", "\x1fxy"]
    got = by_id(exact.exact_groups(frame(spark, texts)), "keep_id", "group_size", "kept", "text_sha256")
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    groups = defaultdict(list)
    for i, n in enumerate(norm):
        groups[n].append((-len(texts[i] or ""), i))
    for i, n in enumerate(norm):
        keep = min(groups[n])[1]
        assert got[i] == (keep, len(groups[n]), keep == i, hashlib.sha256(n.encode()).hexdigest())


def test_exact_groups_of_rows_alike(spark):
    rows = exact.exact_groups(frame(spark, ["a", "a", "a ", None], ids=[3, 3, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows) == [
        ("3", "None", 3, False), ("3", "None", 3, False), ("None", "None", 1, True), ("None", "None", 3, True)
    ]
    rows = exact.exact_groups(frame(spark, ["a", "a"], ids=[3, 3])).collect()
    assert sorted(r["kept"] for r in rows) == [False, True]


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 500, dtype=np.uint64)
    parts = [rng.choice(values, 900) for _ in range(5)] + [np.zeros(0, np.uint64), np.array([0, 2**64 - 1] * 2, np.uint64)]
    filters = [exact.CountingQuotientFilter.of(p) for p in parts]
    again = [exact.CountingQuotientFilter.unpacked(**s.packed()) for f in filters for _, s in f.segments()]
    whole = exact.CountingQuotientFilter.merged(again)
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == Counter(np.concatenate(parts).tolist())


# ---- shards -----------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(1500)] + ["copy of many"] * 40 + [None, "", "ü"]
    rows = shards.shard_documents(frame(spark, texts), shards=24, block_rows=100).collect()
    assert len(rows) == len(texts)
    size, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        home[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean


def test_tree_cuts_at_weighted_medians(spark):
    """Every node against all cuts of its points, computed plainly."""
    rng = random.Random(12)
    rows = [(i, 1, rng.choice([1, 5, 40, 2000]), *[rng.randrange(1 << 60) if rng.random() < 0.8 else 7 << 40 for _ in range(3)]) for i in range(700)]
    cloud = spark.createDataFrame(rows, "_text_hash long, _size long, _weight long, _d0 long, _d1 long, _d2 long")
    nodes = shards.kd_tree(cloud, 11)
    inside, seen = {0: rows}, 0
    for node in nodes:
        mine = inside[node.name]
        if node.children is None:
            assert node.shards == 1
            continue
        span = [max(r[3 + d] for r in mine) - min(r[3 + d] for r in mine) for d in range(3)]
        assert node.dimension == span.index(max(span))
        total = sum(r[2] for r in mine)
        goal = total * (node.shards // 2) / node.shards
        key = 3 + node.dimension
        cuts = sorted({r[key] for r in mine}) + [1 << 61]
        best = min(abs(sum(r[2] for r in mine if r[key] < c) - goal) for c in cuts)
        error = abs(sum(r[2] for r in mine if r[key] < node.cut) - goal)
        assert error <= max(best, shards.TOLERANCE * goal / max(1, node.shards // 2)) + 1e-6
        seen += 1
        low, high = node.children
        inside[low] = [r for r in mine if r[key] < node.cut]
        inside[high] = [r for r in mine if r[key] >= node.cut]
    assert seen == 10


def test_shards_of_few_points(spark):
    rows = shards.shard_documents(frame(spark, ["same"] * 7, ids=[1] * 7), shards=5).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(7))


# ---- chat -------------------------------------------------------------------------------------

NASTY = ["</s>", "<s>[INST] x [/INST]", "[SEP]", "<\\s>", "<\\\\/s>\\", "[", "<", "[INST", "]", "", "\n", "<<s>>", "[[SEP]]", "a\\", "é</s", "$1\\2"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    turns = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 5)))
            turns.append((conv, turn, rng.choice(["user", "assistant", "assistant", "[INST]", "", None]), text))
    turns += [(None, None, None, None), (-5, 0, "assistant", None), (-5, 0, "assistant", None), (-5, None, "user", "first")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, _turns string")
    rows = chat.format_conversations(df).select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_trained(F.col("formatted"), F.col("loss_mask")).alias("trained"),
    )
    want = defaultdict(list)
    for conv, turn, role, text in turns:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in rows.collect()}
    assert set(got) == set(want)
    for conv, said in want.items():
        said = sorted(said)
        assert [tuple(t) for t in got[conv]["turns"]] == [s[2:] for s in said]
        assert got[conv]["trained"] == "".join(s[3] for s in said if s[2] == "assistant")


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string"
    )
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "<s>[INST]user[/INST]a[SEP]b</s><s>[INST]assistant[/INST]c</s>"
    assert row["loss_mask"] == [False, False, False, False, False, False, True, False]


# ---- packing ----------------------------------------------------------------------------------


@pytest.mark.parametrize("open_windows", [4096, 3])
def test_packing(spark, monkeypatch, open_windows):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "OPEN_WINDOWS", open_windows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(9)
    alphabet = ["a", "é", "b's", " ", "  ", "\n", "\t", "1", "...", "’", "\x1c", "漢", "😀", "'ll", "<|endoftext|>", "Ab", "½"]
    texts = odd_texts() + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 900))) for _ in range(200)]
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(frame(spark, texts)).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        docs[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], len(ids)))
    codes = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, code in enumerate(codes):
        pieces = sorted(docs[i], key=lambda p: p[0])
        assert np.concatenate([p[1] for p in pieces]).tolist() == [*code.ids, 0]
        assert [p[0] for p in pieces] == np.cumsum([0, *[len(p[1]) for p in pieces[:-1]]]).tolist()
        assert {p[2] for p in pieces} == {len(code.ids) + 1}
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts[:-1]]]).tolist()
        size = sum(p[1] for p in parts)
        assert size <= 1024 and size.bit_count() == 1


def test_level_choice_is_the_least_sum_of_squares():
    rng, packer = random.Random(1), packing.SumOfSquares(16)
    for n in range(400):
        size, counts = rng.randrange(1, 16), packer.counts.copy()
        options = {}
        for level in range(0, 16 - size + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 16
            options[level] = int((after**2).sum())
        packer.place((n, 0, np.zeros(size, "<u4"), size))
        assert int((packer.counts**2).sum()) == min(options.values())
        assert all(len(packer.open[h]) == packer.counts[h] for h in range(17))


# ---- languages --------------------------------------------------------------------------------


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language.held_out())
    learnt = language.prototypes(docs.filter("NOT held"), "doc_id", "text", "lang")
    assert sorted(learnt) == ["de", "en", "es", "fr"]
    rows = language.identify(docs, learnt).filter("held").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_texts_without_language(spark):
    learnt = {"en": language.Profiles().vector("this is the english of the test")}
    texts = [None, "", "123 ...", "the test is this", "日"]
    got = by_id(language.identify(frame(spark, texts), learnt), "lang_pred", "score")
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "en", "en"] and got[0][1] == 0.0 < got[3][1]
    assert {r["lang_pred"] for r in language.identify(frame(spark, texts), {}).collect()} == {"und"}
    assert language.prototypes(frame(spark, texts, lang=None), "doc_id", "text", "lang") == {}


def test_profile_is_the_bundle_of_bound_letters():
    text = "Abc ab 1 c"
    letters = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int) for c in "abc "}
    total = 0
    for word in ("abc", "ab", "c"):
        padded = f" {word} "
        for x, y, z in zip(padded, padded[1:], padded[2:]):
            total = total + np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
    assert np.allclose(language.Profiles().vector(text), total / np.sqrt((total**2).sum()), atol=1e-5)


def brute_profile(text):
    """Sum of the bound trigram vectors of a text, by the definition."""
    total = np.zeros(language.DIMENSIONS)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        letters = [language.letter_vectors(np.array([c]))[0].astype(np.int64) for c in [0, *map(ord, word), 0]]
        for x, y, z in zip(letters, letters[1:], letters[2:]):
            total = total + np.roll(x, 2) * np.roll(y, 1) * z
    return total


def test_prototypes_and_choice_by_definition(spark):
    rng = random.Random(6)
    sounds = {"aa": ["la", "mi", "to"], "bb": ["ke", "mi", "zu"], "cc": ["la", "zu", "po"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[s], k=3)) for _ in range(rng.randrange(1, 9))), s) for i in range(60) for s in [rng.choice(list(sounds))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learnt = language.prototypes(df, "doc_id", "text", "lang")
    units = [(s, v / np.linalg.norm(v)) for _, t, s in rows for v in [brute_profile(t)]]
    want = {s: sum(v for x, v in units if x == s) for s in sounds}
    want = {s: v / np.linalg.norm(v) for s, v in want.items()}
    assert list(learnt) == sorted(want) and all(np.allclose(learnt[s], want[s], atol=1e-5) for s in want)
    asked = [(100 + i, " ".join(rng.choices(["lamito", "kemizu", "lazupo", "tozu"], k=3)), None) for i in range(40)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(asked, df.schema), learnt).collect()}
    for i, text, _ in asked:
        unit = brute_profile(text) / np.linalg.norm(brute_profile(text))
        cosines = {s: float(unit @ v) for s, v in want.items()}
        assert abs(got[i][1] - max(0, max(cosines.values()))) < 1e-4 and cosines[got[i][0]] > max(cosines.values()) - 1e-4


# ---- pages ------------------------------------------------------------------------------------


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>x{{}}</style></head><body>{body}</body></html>"


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, _host string, text string")
    return {r["page_id"]: r["text"] for r in html.extract_pages(df.repartition(2)).collect()}


def test_pages_with_articles(spark):
    frame_of = "<nav><a>Home</a></nav><header>Site</header>{}<aside>More</aside><footer>&copy; x</footer><script>a('</p>')</script>"
    inner = "<article><h1>H{0} &amp; co</h1><p>One\n  <b>tw</b>o{0}<p>three<div class='ad'>Buy</div><form>F</form><div id=comments>C</div></article>"
    pages = [(i, f"http://a.example/{i}", page(frame_of.format(inner.format(i)))) for i in range(5)]
    pages += [(9, "http://A.example/9", page(frame_of.format("<article>only &#233; &lt;text&gt;<!-- no --></article>"))[:-20])]
    got = extracted(spark, pages)
    assert all(got[i] == f"H{i} & co One two{i} three" for i in range(5)) and got[9] == "only é <text>"


LAYOUTS = ["has-sidebar", "content-with-sidebar", "no-sidebar", "search-results", "layout header-fixed", "comment-page", "search", "header"]


def test_layout_classes_keep_the_article(spark):
    pages = []
    for i, name in enumerate(LAYOUTS):
        for n in range(2):
            inner = f"<div class='sidebar'>Side</div><article><p class='notice-of-award'>Award {n}</p><p>Text {i} {n}</p><div class='ad'>Buy</div></article>"
            pages.append((10 * i + n, f"http://{i}.example/{n}", page(f"<div class='{name}'>{inner}</div><div class='comments'><article>Reader {n}</article></div>")))
    got = extracted(spark, pages)
    for i in range(len(LAYOUTS) - 2):
        assert [got[10 * i + n] for n in range(2)] == [f"Award {n} Text {i} {n}" for n in range(2)], LAYOUTS[i]
    for i in (6, 7):  # marked by whole words, with nothing clear of marks on the page: better too much than nothing
        assert all(f"Award {n} Text {i} {n}" in got[10 * i + n] for n in range(2)), LAYOUTS[i]


def test_wrapper_decides_where_no_tag_does(spark):
    """Inside the content region what is the same on all pages goes. By one page alone it could not be told."""
    body = "<div class=a><div class=c><div class=s>Share this with your friends</div><h2>Title {0}</h2><div class=t>{1}</div><div class=u>All rights kept</div></div></div>"
    pages = [(i, f"https://c.example/{i}", page(body.format(i, f"text {i} " * (i + 3)))) for i in range(5)]
    got = extracted(spark, pages)
    assert got == {i: f"Title {i} " + " ".join([f"text {i}"] * (i + 3)) for i in range(5)}
    alone = html.extract(pages[0][2], None, ([], False))
    assert "Share this" in alone and "All rights" in alone


def test_constant_blocks_of_an_article_stay(spark):
    pages = [(i, f"https://d.example/{i}", page(f"<div class=l>Menu</div><article><h1>News</h1><p>Text {i}</p></article>")) for i in range(5)]
    assert extracted(spark, pages) == {i: f"News Text {i}" for i in range(5)}


def test_deep_pages(spark):
    pages = [
        (0, "http://e.example/0", "<div>" * 10_000 + "deep" + "</div>" * 10_000),
        (1, "http://e.example/1", "<div>" * 10_000 + "deeper"),
        (2, "http://e.example/2", "<font>" * 10_000 + "inline <p>and a block"),
        (3, "http://e.example/3", "<article>" + "<b><div>" * 5_000 + "both</article>"),
    ]
    got = extracted(spark, pages)
    assert got[0] == "deep" and got[1] == "deeper" and got[3] == "both" and "and a block" in got[2]


def test_wrapper_does_not_grow_with_the_pages():
    rng, wrapper, sizes = random.Random(3), None, []
    for i in range(10_000):
        divs = "".join(f"<div class='x{rng.choice('abcdefgh')}{''.join(rng.choices('abcdefghij', k=8))}' id='n{rng.random()}'>t</div>" for _ in range(3))
        shape = html._light(html._page_shape(page(f"{divs}<div class=text>Text {i}</div>")))
        wrapper = shape if wrapper is None else html.merged(wrapper, shape)
        if wrapper.pages % html.THIN_EVERY == 0:
            wrapper = html.thinned(wrapper)
            sizes.append(sum(1 for _ in wrapper.below()))
    assert wrapper.pages == 10_000 and max(sizes) <= 5
    assert html.Shape.unpacked(wrapper.packed()).packed() == wrapper.packed()


def test_pages_without_articles(spark):
    """What is the same on all pages is template, what varies is content."""
    body = "<div class=top><p>Welcome to the site</p></div><div class=x><div class=y><h2>Title {0}</h2><p>Text of page {0} {1}</p></div></div><div class=end><p>Legal words</p></div>"
    got = extracted(spark, [(i, f"https://b.example/{i}", page(body.format(i, "word " * i))) for i in range(4)])
    assert got == {i: f"Title {i} Text of page {i}" + " word" * i for i in range(4)}


def test_odd_pages(spark):
    same = page("<article><p>Same</p></article>")
    got = extracted(spark, [
        (0, None, None), (1, "", ""), (2, "http://c.example/a", same), (3, "http://c.example/b", same), (4, "nonsense", "plain < text"),
        (5, "http://d.example", "<p>a<p>b<br>c"), (6, "http://e.example", page("<article>x</article><div class=ad>y</div><article>z</article>")),
        (7, "http://f.example", "<script>never closed <p>x</p>"), (8, "http://g.example", page("<article>" + "<p>w</p>" * 3000 + "</article>")),
    ])
    assert got[0] == got[1] == got[7] == "" and got[2] == got[3] == "Same" and got[4] == "plain < text"
    assert got[5] == "a b c" and got[6] == "x z" and got[8] == " ".join(["w"] * 3000)


# ---- empty tables -----------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    results = [
        decontaminate.contamination_report(none, bench),
        decontaminate.decontaminate(none, bench),
        substrings.dedup_substrings(none),
        lines.dedup_lines(none),
        simhash.near_duplicates(none),
        simhash.one_of_each(none),
        exact.exact_groups(none),
        shards.shard_documents(none),
        packing.pack(none),
        language.identify(none, {}),
        chat.format_conversations(none.selectExpr("doc_id conv_id", "n_chars turn", "lang role", "text")),
        html.extract_pages(none.selectExpr("doc_id page_id", "lang url", "text html")),
    ]
    assert [r.count() for r in results] == [0] * len(results)
