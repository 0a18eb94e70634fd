import random

from terrahac.llm.queries import vocabulary
from terrahac.llm.token_count import UNKNOWN, WORDS, Automaton, pieces_of, token_counts


def brute(word, initial, rest):
    at = n = 0
    while at < len(word):
        pieces = rest if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return UNKNOWN + 1
        at, n = end, n + 1
    return n


def test_small_vocabularies():
    rng = random.Random(8)
    for _ in range(60):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        initial, rest = {piece() for _ in range(rng.randint(1, 12))}, {piece() for _ in range(rng.randint(1, 12))}
        machine = Automaton(initial, rest)
        for _ in range(200):
            w = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 14)))
            assert machine.count(w) == brute(w, initial, rest), (w, initial, rest)


def test_public_vocabulary_against_library():
    from tokenizers import models

    initial, rest = pieces_of(vocabulary("piece_bpe_32k.model"))
    machine = Automaton(initial, rest)
    every = {"[UNK]": 0} | {p: i + 1 for i, p in enumerate(initial)}
    every |= {"##" + p: len(every) + i for i, p in enumerate(rest)}
    theirs = models.WordPiece(vocab=every, unk_token="[UNK]", max_input_chars_per_word=10_000_000)
    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("theandiongrsß漢é☃7,") for _ in range(rng.randint(1, 30)))
        got = theirs.tokenize(w)
        want = UNKNOWN + 1 if got[0].value == "[UNK]" else len(got)
        assert machine.count(w) == want


def test_rows(spark):
    initial, rest = ["a", "ab", "."], ["b", "c"]
    docs = spark.createDataFrame([(1, "ab abc. a", 7), (1, "ab abc. a", 7), (2, None, 0), (3, " \n", 0), (None, "zz ab", 1), (4, "abc " * 100_000, 0)], "doc_id long, text string, n_words int")
    got = sorted(map(tuple, token_counts(docs, initial, rest).collect()), key=repr)
    assert got == sorted([(1, 4, 5, 0), (1, 4, 5, 0), (2, 0, 0, 0), (3, 0, 0, 0), (None, 2, 2, 1), (4, 100_000, 200_000, 0)], key=repr)
    assert token_counts(docs.limit(0), initial, rest).count() == 0
    assert WORDS.findall("It's a_b, 1.5!") == ["It", "'", "s", "a", "_", "b", ",", "1", ".", "5", "!"]
