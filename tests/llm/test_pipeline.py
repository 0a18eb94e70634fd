import hashlib

import corpus_pipeline
from terrahac.llm import queries
from tests.llm.test_chosen_path import brute as groups
from tests.llm.test_decontaminate import brute as contaminated

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [r for r, (doc_id, low, _) in zip(sorted(rows), groups(sorted(rows))) if doc_id == low]
    bad = {r[0] for r in contaminated(rows, items, 13) if r[-1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = []
    for doc_id, text in rows:
        if doc_id not in bad:
            ids = sp.encode(text)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(want) and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_copies_go_by_row_where_ids_repeat(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near, alone = long + " end", " ".join(f"c{i}" for i in range(60))
    rows = [(5, near), (5, other), (2, long), (7, alone), (7, alone), (9, "x y"), (9, "z"), (None, long), (None, long), (None, "an unnamed text"), (None, "an unnamed text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in queries.without_copies(spark, docs, SF).collect())))
    assert got == sorted(map(repr, [(5, other), (2, long), (7, alone), (9, "x y"), (9, "z"), (None, "an unnamed text"), (None, None)]))
