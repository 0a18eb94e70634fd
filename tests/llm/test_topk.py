import random

import numpy as np

from terrahac.llm import queries, topk
from tests.llm.util import same_as_sql

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    same_as_sql(queries.op7_topk(spark, SF), queries.OP7_SQL, SF)


def test_odd_vectors_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(20)], "x") for i in range(300)]
    rows += [(5, [1.0] * 20, "again"), (5, [1.0] * 20, "again"), (1000, None, ""), (1001, [1.0, None] * 10, ""), (1002, [float("nan")] * 20, ""), (1003, [float("inf")] * 20, ""), (1004, [2.0], ""), (1006, [-3.0], ""), (None, [1.0] * 20, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = topk.scaled(df, 2)
    asked = vectors.filter("vec_id % 2 = 0")
    good = [(i, [int(2 * x) for x in v]) for i, v, _ in rows if i is not None and (i < 1000 or i in (1004, 1006))]
    want = []
    for qi, q in good:
        if qi % 2 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi and len(v) == len(q))[:7]
            want += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    for block in (1000, 40):
        got = topk.top_k(vectors, asked, k=7, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.limit(0), asked.limit(0)).count() == 0


def test_bounds_drop_most_candidates():
    """Over all vectors of sf0.1, more than half of the pairs are out before the last block of dimensions."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    rows = [r for r in rows if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    v = np.floor(1024 * np.array([r["embedding"] for r in rows], dtype=np.float64))
    asked = np.flatnonzero(ids % 100 == 0)
    seeds = np.arange(0, len(ids), max(1, len(ids) // topk.SEEDS))
    best = (np.full((len(asked), 10), -np.inf), np.full((len(asked), 10), np.iinfo(np.int64).max))
    bounds = topk.first_bounds(v[asked], ids[asked], (ids[seeds], v[seeds]), 10)
    dropped = [0, 0]
    for at in range(0, len(ids), topk.TILE):
        best = topk.search_tile(v[asked], ids[asked], np.ascontiguousarray(v[at : at + topk.TILE].T), ids[at : at + topk.TILE], 10, best, bounds, dropped)
    print("dropped", dropped[0] / dropped[1])
    assert dropped[0] > 0.5 * dropped[1]
    score = v[asked] @ v.T
    score[ids[asked][:, None] == ids[None, :]] = -np.inf
    for row, s in enumerate(score):
        top = np.lexsort((ids, -s))[:10]
        assert best[0][row].tolist() == s[top].tolist() and best[1][row].tolist() == ids[top].tolist()
