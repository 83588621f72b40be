"""Ids of the packing query next to the file's encoder as loaded."""

import random
import zlib

import numpy as np
import public_tokenizers
from test_corpus_rows import frame
from tokenizers import Tokenizer

import corpus_pipeline
from episurv.llm import queries


def test_added_tokens_have_their_ids(spark, tmp_path):
    rng = random.Random(9)
    alphabet = ["a", "é", " ", "  ", "\n", "1", "’", "漢", "😀", "'ll", "<|endoftext|>", "<|endoftext", "|>", "Ab"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext", None]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300))) for _ in range(100)]
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [[*e.ids, 0] for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275, 0]
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
    for r in queries.op5_pack(spark, str(tmp_path)).collect():
        part = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(part.tobytes()))
