import hashlib

import pyarrow.parquet as pq
import pytest

from ledgerline.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n \t x", "it's we'll THEY'RE", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "é😀ü 漢字かな  ١٢٣ ½", "x" * 5000,
    " " * 3000 + "end", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" * 50, "\u0000\u0085 　 a b", "é" * 30, "ß" * 999, "the the the", "the the the",
]


def test_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_digest(docs, PATH).collect()}
    full = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        assert full[i].ids == ids and full[i].decoded == said, x
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_checked_ids_are_those_of_encode_and_give_the_text_again(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    full = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    got = {r.doc_id: r for r in bpe.encode_checked(docs, PATH).collect()}
    assert len(got) == len(ODD) and all(got[i].ids == full[i].ids and got[i].intact and full[i].decoded == (x or "") for i, x in enumerate(ODD))


def test_empty_table(spark):
    assert bpe.encode_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
