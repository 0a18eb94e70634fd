import random

from terrahac.llm import chosen_path, queries
from terrahac.llm.chosen_path import similar_documents
from terrahac.llm.components import components
from terrahac.llm.words import words
from tests.llm.util import same_as_sql

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    same_as_sql(queries.op5_similar(spark, SF), queries.OP5_SQL, SF)


def brute(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").encode())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    low = {}
    for i in range(n):
        low[label[i]] = min(low.get(label[i], rows[i][0]), rows[i][0])
    return sorted((rows[i][0], low[label[i]], sum(linked[i])) for i in range(n))


def test_brute_force_with_splits_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(30):  # one group whose members differ in a few words, around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(30, 60):  # many that share a passage only
        rows.append((i, " ".join(base[:40] + [rng.choice(vocab) for _ in range(100)])))
    rows += [(70, None), (71, ""), (72, "..."), (73, "a b"), (74, "A, b!"), (75, rows[3][1].upper()), (76, rows[3][1])]
    rows += [(80, "z " * 50_000), (81, "Z " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class_id string, node int")
    for leaf in (128, 4):
        got = similar_documents(docs, leaf=leaf).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, t), (1, t), (2, t + " x"), (None, t), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, similar_documents(docs).collect()), key=repr)
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (None, None, 0), (None, None, 0)]
    assert similar_documents(docs.limit(0)).count() == 0
    kept = queries.without_copies(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in up.items() if k not in loops or v != k} == {k: v for k, v in got.items() if k not in loops or v != k}
