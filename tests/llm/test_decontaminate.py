import hashlib
import pickle
import random
import re

from terrahac.llm import queries
from terrahac.llm.decontaminate import Index, decontaminate
from tests.llm.util import same_as_sql

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_against_sql(spark):
    same_as_sql(queries.op1_decontaminate(spark, SF), queries.OP1_SQL, SF)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, names = set(), set()
        for name, t in items:
            v = WORD.findall(lower(t))
            if name is None or not v:
                continue
            n = min(window, len(v))
            for i in range(len(v) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_brute_force_in_one_and_many_blocks(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "é", "Ä", "x9", "dd"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, text(8)), (50, None), (51, "!!"), (None, "a b"), (52, "é")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "?! "), (5, "a B é"), (5, "a B é"), (None, "a b é ä")]
    docs.append((200, ("zz " * 3000 + items[0][1]) * 3))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items, 5)
    for block in (1_000_000, 60):
        got = decontaminate(d, b, window=5, shingle=3, block_bytes=block).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate(d, b.limit(0)).collect()} == {0}


def test_memory_of_a_block():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12))) for _ in range(5000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))).encode()) for i in range(2000)]
    index = Index(items, 13, 4)
    index.order({})
    table_of_bits = sum(len(x[0].bits) for x in index.prefix.values())
    assert len(pickle.dumps(index)) - table_of_bits < 8 * sum(len(t) for _, t in items)
    assert index.window(0).count(b" ") + 1 == index.lengths[0] and index.items(0)
