import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrahac.llm import lbl_lm, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    """The exact columns, by doc_id, from rows (doc_id, text) of the whole table."""
    split = {i: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["<end> "] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in split.items()}


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    out = queries.op6_lm_scores(spark, SF).collect()
    assert len(out) == len(want)
    for r in out:
        held, n_tokens, n_known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens
    print("gain in log10 a token", gain)
    assert gain > 0.3


def test_odd_rows(spark):
    rows = [(i, f"a b c w{i} A", 0.5) for i in range(30)] + [(3, "a b c w3 A", 0.5), (100, None, 0.1), (101, "", 0.1), (102, "z " * 50_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = lbl_lm.scores(docs, leaves=4, head=6).collect()
    assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (100, 101)} == {1}
    want = brute([(1000 + i, t) if j == 30 else (i, t) for j, (i, t, _) in enumerate(rows)])
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    small = lbl_lm.scores(docs.filter("doc_id <> 3"), leaves=4, head=6).collect()
    want = brute([(i, t) for i, t, _ in rows if i != 3])
    for r in small:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    assert lbl_lm.scores(docs.limit(0)).count() == 0
    only = lbl_lm.scores(docs.filter("false").union(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))).collect()
    assert only and all(r.held_out and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in only)


def by_hand(words, model, counts, text):
    """log10 probability of a text by the definition: one token at a time, over all groups and all leaves of one."""
    p, split = model.p, lbl_lm.tokens(text)
    leaves = [int(words.leaf[words.index[w]]) if w in words.index else words.hashed(w) for w in split] + [words.end]
    seen = [words.before] * lbl_lm.SPAN + leaves
    total = 0.0
    for i, leaf in enumerate(leaves):
        past = seen[i : i + lbl_lm.SPAN]
        h = p["near"][past[-1]].astype(float) + sum(p["far"][x].astype(float) for x in past[:-1])
        group = min(leaf // words.size, words.groups)
        s = p["group"] @ h + p["group_b"]
        total += s[group] - math.log(np.exp(s).sum())
        if leaf == words.end:
            continue
        of = slice(group * words.size, (group + 1) * words.size)
        s = p["leaf"][of] @ h + p["leaf_b"][of]
        total += s[leaf - of.start] - math.log(np.exp(s).sum())
        if leaf % words.size >= words.own:
            here = [n for w, n in counts.items() if (int(words.leaf[words.index[w]]) if w in words.index else words.hashed(w)) == leaf]
            total += math.log((counts.get(split[i], 0) + 1) / (sum(here) + len(here) + 1))
    return total / math.log(10)


def test_scores_by_hand(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 400))) if x < 500)
    docs = spark.createDataFrame([(i, text(), i % 3 == 0) for i in range(60)], "doc_id long, __text string, held_out boolean")
    words, model, table = lbl_lm.learn(docs.filter("not held_out").select("__text"), leaves=40, head=70)
    counts = {bytes(r.word): r.n for r in table.collect()}
    assert len(counts) > 70 and words.groups > 3
    # Every word of the counts and one unseen word of each shared leaf, after some context: a total of one.
    ids = np.array([words.before, 3, 5, 1, 40, 2, 9, 7], dtype=np.int32)
    p = 0.0
    for leaf in [*range(words.end), words.end]:
        row = np.full((1, lbl_lm.SPAN + lbl_lm.LENGTH), words.before, dtype=np.int32)
        row[0, : lbl_lm.SPAN], row[0, lbl_lm.SPAN] = ids, leaf
        p += 10 ** model.log10(row)[0]
    assert p == pytest.approx(1, abs=1e-4)
    shared = np.flatnonzero(~words.alone)
    share = dict.fromkeys(shared.tolist(), 1.0)
    for w, n in counts.items():
        leaf = int(words.leaf[words.index[w]]) if w in words.index else words.hashed(w)
        if leaf in share:
            share[leaf] += n + 1
    assert [math.log10(x) for x in share.values()] == pytest.approx(words.bottoms[shared].tolist())
    got = {r.doc_id: r.score for r in lbl_lm.apply(docs, words, model, table).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(by_hand(words, model, counts, r["__text"].encode()), rel=1e-4)


def test_training_learns_a_repeated_text():
    words = lbl_lm.Words([(b"w%d" % i, 50 - i) for i in range(30)], 5, 2000, 80, 20)
    model = lbl_lm.Model(words)
    model.prepare()
    rng = np.random.default_rng(0)
    rows = lbl_lm.stretches(words.coded([b"w1 w2 w3 w4 zz w1 w1 w9"] * 40)[0], words.before)
    first = model.log10(rows).sum()
    for _ in range(300):
        model.train(rows, rng, 0.1)
    assert model.log10(rows).sum() > 0.2 * first  # the repeated text is learned
    assert all(np.isfinite(x).all() for x in model.p.values())


def test_a_row_is_averaged_by_what_was_learned_about_it():
    half = lambda v: np.array(v, dtype=np.float16).tobytes()
    full = lambda v: np.array(v, dtype=np.float32).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(["far", "far", "leaf"]), pa.array([0, 0, 0], pa.int64()), pa.array([half([[1, 1], [2, 2]]), half([[5, 5], [4, 4]]), half([[7, 7]])], pa.binary()), pa.array([full([0, 1]), full([2, 3]), full([1])], pa.binary())], names=["name", "lo", "rows", "learned"])
    a, b = (x for x in lbl_lm._average(iter([batch])))
    assert np.frombuffer(a.column("rows")[0].as_py(), dtype=np.float32).tolist() == [5, 5, 3.5, 3.5]
    assert np.frombuffer(a.column("learned")[0].as_py(), dtype=np.float32).tolist() == [2, 2.5]
    assert b.column("name")[0].as_py() == "leaf"


def test_leaves_grow_with_the_kinds_of_words():
    small, large = lbl_lm.sizes(10_000), lbl_lm.sizes(50_000_000)
    assert large[0] > 10 * small[0] and large[1] > 10 * small[1]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"a{i}", f"x y z{i}") for i in range(20)] + [(None, "x")], "doc_id string, text string")
    out = lbl_lm.scores(docs).collect()
    assert len(out) == 21 and {type(r.doc_id) for r in out} == {str, type(None)}


def test_context_sums_hold_no_rest_of_words_before():
    """A context's vector is the sum of its own words, however large an earlier word's vector is."""
    rng = np.random.default_rng(3)
    words = lbl_lm.Words([(b"a", 5), (b"b", 3), (b"c", 2)], 2, 10, 3, 3)
    model = lbl_lm.Model(words)
    ids = rng.integers(0, 3, (2, lbl_lm.SPAN + lbl_lm.LENGTH)).astype(np.int32)
    ids[:, 0] = words.before
    model.p["far"][words.before] = 1e8
    got = model.hidden(ids)
    for t in (0, 1, 60, lbl_lm.LENGTH - 1):
        want = model.p["far"][ids[:, t : t + lbl_lm.SPAN - 1]].astype(float).sum(axis=1) + model.p["near"][ids[:, t + lbl_lm.SPAN - 1]]
        assert np.allclose(got[:, t], want, atol=1e-5, rtol=1e-6)


def test_window_sums_add_to_the_gradients_of_both_sides():
    x = np.random.default_rng(4).normal(size=(3, 40, 2)).astype(np.float32)
    want = np.stack([x[:, i : i + lbl_lm.SPAN - 1].sum(axis=1) for i in range(40 - lbl_lm.SPAN + 2)], axis=1)
    assert np.allclose(lbl_lm.window_sums(x), want, atol=1e-5)


def test_rows_are_gathered_as_by_index():
    x, rng = np.arange(60, dtype=np.float32).reshape(20, 3), np.random.default_rng(3)
    for at in (rng.integers(0, 20, 50, dtype=np.int32), rng.integers(0, 20, (4, 6)), np.zeros(0, dtype=np.int64)):
        got = lbl_lm.rows_of(x, at)
        assert got.dtype == x.dtype and got.shape == (*at.shape, 3) and (got == x[at]).all()
        got[...] = -1  # a copy
    assert (x >= 0).all()


def test_words_are_found_in_arrays_by_all_their_bytes():
    parts = [b"a", b"B", b"\x00", b" ", b"\t", b"\x0b", b"\x1f", b"\x85", b"\xc3\xa9", b"z", b"\n"]
    rng = np.random.default_rng(5)
    texts = [b"".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in (0, 1, 2, 50, 400, 3000)]
    texts += [None, b"", b" \t"] + [b"q" * n + b" " + b"q" * (n - 1) + b"r" for n in (7, 8, 9, 16, 17, 200, 201, 5000)]
    cut, want = lbl_lm.Cut(texts), [lbl_lm.tokens(t) for t in texts]
    flat = [w for ws in want for w in ws]
    assert cut.sizes.tolist() == [len(ws) for ws in want] and cut.words(np.arange(len(flat))) == flat
    kinds = [w for w in dict.fromkeys(flat) if len(w) <= lbl_lm.Places.LONGEST][::2]
    index = {w: i for i, w in enumerate(kinds)}
    found = lbl_lm.Places(kinds)
    assert found.of(cut).tolist() == [index.get(w, -1) for w in flat]
    found.keys[:] = found.keys[0]  # words of one key are told apart by their bytes
    assert not any(flat[i] != kinds[p] for i, p in enumerate(found.of(cut)) if p >= 0 and len(flat[i]) > 8)
    assert lbl_lm.Places([]).of(cut).tolist() == [-1] * len(flat)


def test_counts_of_several_batches(monkeypatch):
    monkeypatch.setattr(lbl_lm, "small_batches", lambda batches, column, size: batches)
    texts = [["A b  a", "c"], ["b d" + " x" * 300, None, "d " + "y" * 300], ["a b d e" + " " + "y" * 300]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["__text"]) for t in texts]
    counts = Counter()
    for batch in lbl_lm._count_words(iter(batches)):
        for w, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[w] += n
    assert counts == Counter(w for ts in texts for t in ts for w in lbl_lm.tokens(t and t.encode()))


@pytest.mark.parametrize("times", [0, 1, 4, 40])
def test_sums_of_scores_are_those_of_exp(times):
    """Sums without exp, and those of rows and models that need exp itself: all are the logarithms of the definition."""
    words = lbl_lm.Words([(b"w%d" % i, 500 - i) for i in range(400)], 5, 200_000, 900, 300)
    model, rng = lbl_lm.Model(words), np.random.default_rng(6)
    for k in ("near", "far", "leaf", "group"):
        model.p[k] = (model.p[k] * times).astype(np.float32)
    rows = rng.integers(0, words.end + 1, (30, lbl_lm.SPAN + lbl_lm.LENGTH)).astype(np.int32)
    rows[3:5] = words.before
    got = model.log10(rows).reshape(30, -1)
    p, h = {k: v.astype(float) for k, v in model.p.items()}, model.hidden(rows).astype(float)
    leaf, leaf_b = p["leaf"].reshape(words.groups, words.size, -1), p["leaf_b"].reshape(words.groups, -1)
    share = lambda z, i: z[i] - z.max() - math.log(np.exp(z - z.max()).sum())
    for i, t in zip(rng.integers(0, 30, 400), rng.integers(0, lbl_lm.LENGTH, 400)):
        at, want = rows[i, lbl_lm.SPAN + t], 0.0
        if at != words.before:
            g = min(at // words.size, words.groups)
            want = share(p["group"] @ h[i, t] + p["group_b"], g)
            want += share(leaf[g] @ h[i, t] + leaf_b[g], at - g * words.size) if g < words.groups else 0.0
        assert got[i, t] == pytest.approx(want / math.log(10), rel=2e-6, abs=2e-5)


def test_usual_sums_take_no_exp(monkeypatch):
    """Of a model like a trained one, hardly any sum needs exp, which takes most of the time of scoring."""
    words = lbl_lm.Words([(b"w%d" % i, 500 - i) for i in range(400)], 5, 200_000, 900, 300)
    model, rng = lbl_lm.Model(words), np.random.default_rng(7)
    rows = rng.integers(0, words.end, (8, lbl_lm.SPAN + lbl_lm.LENGTH)).astype(np.int32)
    taken, exp = [], np.exp
    monkeypatch.setattr(lbl_lm.np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    model.log10(rows)
    assert sum(taken) < 0.01 * 8 * lbl_lm.LENGTH * (words.groups + words.size)


def test_products_with_one_give_the_gradients_of_biases():
    """Steps of a mini-batch, against gradients summed target by target."""
    words = lbl_lm.Words([(b"w%d" % i, 50 - i) for i in range(30)], 5, 2000, 80, 20)
    model, steps = lbl_lm.Model(words), {}
    model.prepare()
    rows = lbl_lm.stretches(words.coded([b"w1 w2 w3 w4 zz w1 w1 w9", b"w5"] * 9)[0], words.before)
    model._step = lambda name, at, g, rate: steps.__setitem__(name, (at, g))
    model.train(rows, np.random.default_rng(0), 0.1)
    live, target, group = model._sorted(rows)
    h = model.hidden(rows).reshape(-1, lbl_lm.DIM)[live].astype(float)
    draws = np.random.default_rng(0)
    noise = np.minimum(np.searchsorted(model.group_steps, draws.random(lbl_lm.NOISE_GROUPS), side="right"), words.groups)
    less = model.p["group_b"].astype(float) - model.group_log
    sigma = lambda s: 1 / (1 + np.exp(-s)) / len(live)
    want, want_b = np.zeros((words.groups + 1, lbl_lm.DIM)), np.zeros(words.groups + 1)
    for x, g in zip(h, group):
        for i, down in [(g, 1 / len(live)), *((j, 0.0) for j in noise)]:
            d = sigma(model.p["group"][i].astype(float) @ x + less[i]) - down
            want[i] += d * x
            want_b[i] += d
    got, got_b = np.zeros_like(want), np.zeros_like(want_b)
    np.add.at(got, steps["group"][0], steps["group"][1])
    np.add.at(got_b, steps["group_b"][0], steps["group_b"][1])
    assert np.allclose(got, want, atol=1e-5) and np.allclose(got_b, want_b, atol=1e-5)
    assert steps["leaf"][1].shape == (len(steps["leaf_b"][1]), lbl_lm.DIM) and len(steps["leaf"][0]) == len(steps["leaf_b"][0])


def test_many_words_fall_as_one_by_one():
    rng = np.random.default_rng(8)
    some = lambda n: [bytes(rng.choice(list(b"ab\x00\xff"), int(rng.integers(1, 14)))) for _ in range(n)]
    head = list(dict.fromkeys(w for w in some(300) if w.strip()))
    words = lbl_lm.Words([(w, 1000 - i) for i, w in enumerate(head)], 5, 9000, 900, 200)
    assert len(words.bounds) > 8
    many = [*some(2000), *(b[::-1] for b in words.bounds), *(b"a" + b[::-1] for b in words.bounds), *(b[::-1][1:] or b"a" for b in words.bounds)]
    cut = lbl_lm.Cut(many)
    assert cut.words(np.arange(len(many))) == many
    assert words.all_hashed(many, cut, np.arange(len(many))).tolist() == [words.hashed(w) for w in many]
    none = lbl_lm.Words([], 0, 0, 0, 4)
    assert none.all_hashed(many, cut, np.arange(len(many))).tolist() == [none.hashed(w) for w in many]
