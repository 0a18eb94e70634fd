import random

import pytest
from pyspark.sql import Row

from terrahac.llm.queries import vocabulary
from terrahac.llm.sp_codec import Codec, encode_decode

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_same_as_library(model):
    ours, theirs = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    signs = "ab .,\n  ▁éñ漢😀\t\x00'-0123<>&é"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in [*texts, "", " ", "▁x", "<s> <0x41>", "  two  spaces ", "a" * 3000, "word, word. Word!"]:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids
        assert ours.decode(ids) == theirs.decode(ids)


def test_rows(spark, model):
    rows = [Row(doc_id=1, text="Hello there,  world", n_tokens=9), Row(doc_id=1, text="Hello there,  world", n_tokens=9), Row(doc_id=None, text=None, n_tokens=0), Row(doc_id=3, text="", n_tokens=None), Row(doc_id=4, text="x" * 200_000, n_tokens=1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = encode_decode(docs, model, ids=True, check_every=1).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].decoded == "Hello there,  world" and by[1].n_tokens == len(by[1].ids) > 0
    assert by[None].n_tokens == by[3].n_tokens == 0 and by[3].decoded == ""
    assert by[4].decoded == "x" * 200_000
    assert encode_decode(docs.limit(0), model).count() == 0
