import zlib

import numpy as np
from pyspark.sql import functions as F

from terrahac.llm import ppm_langid, queries

SF = "/root/testdata/sf0.01"


def folded(text: bytes) -> bytes:
    return b"   " + text.translate(ppm_langid.FOLD)


def brute_tree(train: list[bytes]) -> dict[bytes, dict[int, int]]:
    tree: dict[bytes, dict[int, int]] = {}
    for t in map(folded, train):
        for i in range(3, len(t)):
            for k in range(4):
                node = tree.setdefault(t[i - k : i], {})
                node[t[i]] = node.get(t[i], 0) + 1
    return tree


def brute_bits(train: list[bytes], text: bytes) -> float:
    return tree_bits(brute_tree(train), text)


def tree_bits(tree: dict[bytes, dict[int, int]], text: bytes) -> float:
    """Code length of text by walking the contexts of a tree, from the longest down."""
    known: dict[bytes, dict[int, float]] = {}

    def p(context: bytes, byte: int | None, order: int) -> dict[int, float]:
        lower = {b: 1 / 256 for b in range(256)} if order == 0 else p(context[1:], byte, order - 1)
        node = tree.get(context)
        if not node:
            return lower
        total, kinds = sum(node.values()), len(node)
        share = sum(v for b, v in lower.items() if b not in node)
        return {b: (node[b] if b in node else kinds * v / share) / (total + kinds) for b, v in lower.items()}

    t = folded(text)
    for i in range(3, len(t)):
        if t[i - 3 : i] not in known:
            known[t[i - 3 : i]] = p(t[i - 3 : i], t[i], 3)
    return float(sum(-np.log2(known[t[i - 3 : i]][t[i]]) for i in range(3, len(t))))


def test_code_lengths():
    train = {"aa": [b"Abra, cadabra abra", b"bar"], "bb": ["été à côté".encode(), b"cab cab"]}
    model = ppm_langid.Model({k: (c, n.astype(float)) for k, v in train.items() for c, n in [ppm_langid.grams(v)]})
    texts = [b"abracadabra zz", "été".encode(), b"", b"q", b"cab"]
    got = model.lengths(texts)
    for t, row in zip(texts, got):
        for k, lang in enumerate(model.langs):
            assert abs(row[k] - brute_bits(train[lang], t)) < 1e-3


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op8_language_id(spark, SF).join(docs, "doc_id")
    right, n, low, high = out.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 150 and right > 0.97 and 0 <= low <= high <= 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", 0.5), (2, None, "en", None), (3, "123 !?", None, 1.0), (4, "", "de", 1.0), (None, "der hund", "de", 0.0), (1, "the cat sat", "en", 0.5)], "doc_id long, text string, lang string, score double")
    got = ppm_langid.identify(docs, queries.language_model(docs), keep=("doc_id", "score")).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"}
    assert queries.language_model(docs.limit(0)) is None
    assert {r.lang_pred for r in ppm_langid.identify(docs, None).collect()} == {"und"}


def test_many_languages_and_long_texts():
    """A model is as large as its trees, and texts may go beyond what is held at a time."""
    rng = np.random.default_rng(3)
    letters = [chr(c).encode() for c in range(0x100, 0x100 + 60 * 12)]
    train = {}
    for k in range(60):
        own = letters[12 * k : 12 * k + 12] + [b"a", b"e", b" "]
        train[f"l{k:02}"] = [b"".join(own[i] for i in rng.integers(0, 15, 300)) for _ in range(4)]
    counts = {k: (c, n.astype(float)) for k, v in train.items() for c, n in [ppm_langid.grams(v)]}
    model = ppm_langid.Model(counts)
    assert model.nbytes < 150 * sum(len(c) for c, _ in counts.values())
    long = b"".join(train["l07"]) * 40  # several times WORK / 60 bytes
    texts = [b"ae", b"", long, train["l41"][0], b"a e"]
    got = model.lengths(texts)
    names, _ = model.predict(texts)
    assert names[2:4] == ["l07", "l41"] and names[1] == "und"
    for t, row in ((texts[0], got[0]), (texts[3], got[3])):
        for lang in ("l00", "l41"):
            assert abs(row[model.langs.index(lang)] - brute_bits(train[lang], t)) < 1e-3 * len(t)
    alone = model.lengths([long])[0]
    assert len(long) > ppm_langid.WORK // 60
    assert np.allclose(got[2], alone)


def test_query_against_brute_force(spark):
    """The registered query's results, from a model that walks the trees for every byte."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    train: dict[str, list[bytes]] = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            train.setdefault(r.lang, []).append(r.text.encode())
    got = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    trees = {k: brute_tree(v) for k, v in train.items()}
    for r in rows:
        text = r.text or ""
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
        elif len(text.encode()) < 1500:
            bits = {k: tree_bits(tree, text.encode()) for k, tree in trees.items()}
            assert got[r.doc_id].lang_pred == min(bits, key=lambda k: (bits[k], k))
