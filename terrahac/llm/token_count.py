"""Token counts by a longest-match automaton, in time linear in the text.

Greedy word pieces: of each word, the longest piece that it begins with, then the longest
continuing piece, and so on; a word for which this fails is one unknown token. The pieces
form a trie with two roots, for a word's start and for its rest. Each of its nodes has a
failure link, which leads to where matching goes on once the pieces that are then certain
have been popped, and the precomputed number of those; so each character of a word is
read once and no piece is built.

Words: runs without white space, of which each ASCII sign is a word of its own.

Defined results: null, empty and blank texts have no words and no tokens; an empty table gives no
rows; texts of any length are read whole; bytes that are no UTF-8 are read as U+FFFD; repeated rows each
get their result; a result column takes the place of a kept column of the same name.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahac.llm.common import column_bytes, ship, small_batches

WORDS = re.compile(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")
#: In a word's value, unknown words are counted above the tokens.
UNKNOWN = 1 << 40
RESULT = ("n_words", "n_tokens", "n_unknown")
CACHE = 400_000


class Automaton:
    """initial: pieces that a word can begin with; rest: pieces that can follow."""

    def __init__(self, initial: Iterable[str], rest: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    if (to := self.next[at].get(c)) is None:
                        to = len(self.next)
                        self.next[at][c] = to
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] |= at > 1
        self.fail = [-1] * len(ends)
        self.pops = [0] * len(ends)
        todo = deque((0, 1))
        while todo:
            parent = todo.popleft()
            for c, node in self.next[parent].items():
                todo.append(node)
                if ends[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][c], popped
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a word that is not empty; UNKNOWN + 1 if no pieces make it up."""
        step, fail, pops = self.next, self.fail, self.pops
        at = total = 0
        for c in word:
            while (to := step[at].get(c)) is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return UNKNOWN + 1
            at = to
        while at != 1:
            total += pops[at]
            at = fail[at]
            if at < 0:
                return UNKNOWN + 1
        return total

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        words = WORDS.findall(text)
        cache = self.cache
        found = list(map(cache.get, words))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    word = words[i]
                    if (n := cache.get(word)) is None:
                        n = self.count(word)
                        if len(word) <= 48:
                            if len(cache) >= CACHE:
                                cache.clear()
                            cache[word] = n
                    found[i] = n
        total = sum(found)
        return len(words), total % UNKNOWN, total // UNKNOWN


_BUILT: dict[int, Automaton] = {}


def automaton(initial: list[str], rest: list[str]) -> Automaton:
    key = hash((tuple(initial), tuple(rest)))
    if key not in _BUILT:
        _BUILT[key] = Automaton(initial, rest)
    return _BUILT[key]


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a sentencepiece vocabulary file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = [p.piece for p in proto.pieces if p.type == p.NORMAL]
    return sorted(p[1:] for p in normal if p[0] == "▁" and len(p) > 1), sorted(p for p in normal if p[0] != "▁")


def token_counts(docs: DataFrame, initial: list[str], rest: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, n_tokens and n_unknown of each row, with its kept columns."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((initial, rest))
    keep = tuple(c for c in keep if c not in RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(*sent.value)
        for batch in small_batches(batches, "__text"):
            rows = [machine.text(t.decode("utf-8", "replace")) if t else (0, 0, 0) for t in column_bytes(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=[*keep, *RESULT])

    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in RESULT]])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
