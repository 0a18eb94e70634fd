"""Language-model scores of a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training documents. The most frequent ones have a leaf of their own,
as many as GROWTH times the root of the kinds of words; every other word, unseen ones too, falls
by its hash into one of HASHED leaves that all words of like endings share. Leaves are put in
order by their words read backwards and cut into groups of equal size, so that a group's words
end alike; the end of a text is a group of its own. The probability of a word is that of its
group, times that of its leaf within the group, times its share of the leaf: 1 for a word that
has the leaf to itself, else the add-one share of its count. So a score takes two sums over about
the root of the leaves each, and all words, with the unseen ones of a leaf as one, share a total of one.

After a context, h is the vector of the word before plus those of the SPAN - 1 words before that
one (of another table); a group or leaf scores h . r + b. Both levels are trained by noise-contrastive
estimation, with noise drawn from the frequencies of groups, and of leaves within each group, shared
by a mini-batch; Adagrad has one sum of squares a row.

Training reads every training text once in each pass, and PASSES times at most where the corpus is
smaller than LEAST tokens. Trainers are tasks that read their own part of the documents; their
number grows with the root of the tokens, and so does the model, so that what they send grows no faster
than the corpus. At the end of a round, a part of a pass, their rows are averaged by how much each has
learned about them: a word that one trainer has met keeps what that one learned. Rows
meet by slabs in a shuffle, and the driver gets the averages only.

Scoring: matrix products over blocks of tokens. HEAD words for each leaf, with their counts, are known
to all tasks; the counts of other words come by a join on the word.

Defined results: a null text is the empty one, whose only token is the end; without training
documents N and V are 0 and all words are unknown; an empty table gives no rows; repeated rows are
scored, and trained on, each; a null doc_id counts as the empty id in the split; ids may be of any type;
other columns, whatever their names, are not read; a text of any length is scored whole.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahac.llm.common import column_bytes, held_out, ship, small_batches, spread, table

#: Least words with a leaf of their own, and their growth with the root of the kinds of words.
LEAVES, GROWTH = 16_384, 24
#: Leaves of a group that words without a leaf of their own share.
HASHED = 32
#: Words whose counts all tasks know, for each leaf.
HEAD = 4
DIM = 24
#: Words of a context, and tokens of a stretch, which is trained on and scored as one row.
SPAN, LENGTH = 8, 128
#: Stretches of a mini-batch; noise groups of a mini-batch and noise leaves of each group.
BATCH, NOISE_GROUPS, NOISE_LEAVES = 128, 64, 16
RATE = 0.25
#: Tokens to be trained on at least, in so many passes at most; rounds at least; stretches that are shuffled at a time.
LEAST, PASSES, ROUNDS, CHUNK = 10_000_000, 10, 4, 2048
#: Trainers are the root of the tokens over this.
TOKENS = 400_000
#: Rows of a slab that meet when trainers are averaged.
SLAB = 4096
#: Scores: rows of a block; halvings of what exp takes, after a shift to where most of a sum lies; logarithms of sums that are usual.
ROWS, HALVINGS, SHIFT, USUAL = 512, 5, 3, (-1.5, 1.5)
_F = np.float32


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, without the end."""
    return text.lower().split() if text else []


class Cut:
    """The words of texts, as tokens() has them: stretches of one buffer, from begin to end; sizes has the words of each text."""

    def __init__(self, texts: list[bytes | None]):
        whole = b" ".join([b"", *[t or b"" for t in texts], b""]).lower()
        self.whole = whole + bytes(-len(whole) % 8 + 16)
        byte = np.frombuffer(whole, dtype=np.uint8)
        space = (byte == 32) | (byte - np.uint8(9) < 5)
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = turns[::2], turns[1::2]
        starts = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.sizes = np.diff(np.searchsorted(self.begin, starts), prepend=0)
        self._eights = np.frombuffer(self.whole, dtype="<u8")

    def eights(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on as a number, those beyond the number left as 0."""
        eight, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = np.take(self._eights, eight) >> shift
        x |= np.take(self._eights, eight + 1) << np.uint64(1) << (np.uint64(63) - shift)
        return x & np.take(_KEPT, np.minimum(left, 8))

    def words(self, at: np.ndarray) -> list[bytes]:
        return [self.whole[b:e] for b, e in zip(self.begin[at].tolist(), self.end[at].tolist())]


_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class Places:
    """Places of words in a list of different words: a hash table in arrays, for many words at a time.

    Words of the list and words looked up are compared by all of their bytes.
    """

    #: Bytes of the longest word of a list; words looked up at a time.
    LONGEST, PIECE = 200, 32_768

    def __init__(self, words: list[bytes]):
        self.own = Cut(words)
        if len(self.own.begin) != len(words) or any(len(w) > self.LONGEST for w in words):
            raise ValueError("words are without white space, and bounded")
        self.bits = max(4, (4 * len(words)).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = self._keys(self.own, self.own.begin, self.own.end)
        self.lengths = (self.own.end - self.own.begin).astype(np.uint8)
        left, slot = np.arange(len(words)), self._slots(self.keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & (len(self.table) - 1)

    def _keys(self, cut: Cut, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each word; those of words of one length up to eight are different."""
        n = end - begin
        h = self._mixed(cut.eights(begin, n))
        longer = np.flatnonzero((n > 8) & (n <= self.LONGEST))
        done = 8
        while len(longer):
            h[longer] = self._mixed(h[longer] ^ cut.eights(begin[longer] + done, n[longer] - done))
            done += 8
            longer = longer[n[longer] > done]
        return h

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h

    def _other(self, place: np.ndarray, cut: Cut, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which words of more than eight bytes differ from those at places, of the same lengths."""
        other, own = np.zeros(len(place), dtype=bool), self.own.begin[place]
        left, done = np.arange(len(place)), 0
        while len(left):
            same = self.own.eights(own[left] + done, n[left] - done) == cut.eights(begin[left] + done, n[left] - done)
            other[left[~same]] = True
            done += 8
            left = left[same & (n[left] > done)]
        return np.flatnonzero(other)

    def of(self, cut: Cut) -> np.ndarray:
        """The place of each word, -1 for those that are not in the list."""
        out = np.full(len(cut.begin), -1, dtype=np.int64)
        for lo in range(0, len(out), self.PIECE):
            begin, end = cut.begin[lo : lo + self.PIECE], cut.end[lo : lo + self.PIECE]
            keys, n = self._keys(cut, begin, end), end - begin
            left, slot = np.flatnonzero(n <= self.LONGEST), self._slots(keys)
            if len(left) < len(slot):
                slot = slot[left]
            while len(left):
                place = np.take(self.table, slot)
                met = np.flatnonzero(place >= 0)
                if len(met) < len(place):
                    place, left, slot = place[met], left[met], slot[met]
                equal = np.take(self.keys, place) == np.take(keys, left)
                equal &= np.take(self.lengths, place) == np.take(n, left)
                long = np.flatnonzero(equal & (np.take(n, left) > 8))
                if len(long):
                    at = left[long]
                    equal[long[self._other(place[long], cut, begin[at], n[at])]] = False
                out[lo + left[equal]] = place[equal]
                left, slot = left[~equal], (slot[~equal] + 1) & (len(self.table) - 1)
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(words: list[bytes], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    # The words of the first texts are counted by their places, others by a dictionary.
    total: Counter = Counter()
    first, places, n = [], None, np.zeros(0, dtype=np.int64)
    for batch in small_batches(batches, "__text", 2_000_000):
        cut = Cut(column_bytes(batch.column("__text")))
        at = np.arange(len(cut.begin)) if places is None else places.of(cut)
        total.update(cut.words(at if places is None else np.flatnonzero(at < 0)))
        if places is None:
            first = [w for w in total if len(w) <= Places.LONGEST]
            places, n = Places(first), np.fromiter(map(total.pop, first), dtype=np.int64, count=len(first))
        else:
            n += np.bincount(at[at >= 0], minlength=len(first))
        if len(total) > 200_000:
            yield rows(list(total), list(total.values()))
            total = Counter()
    yield rows([*first, *total], [*n.tolist(), *total.values()])


def sizes(kinds: int) -> tuple[int, int]:
    """Words with a leaf of their own, and words of the head, for so many kinds of words."""
    leaves = max(LEAVES, GROWTH * math.isqrt(kinds))
    return leaves, HEAD * leaves


class Words:
    """The head of the word counts, and the leaf of any word."""

    def __init__(self, head: list[tuple[bytes, int]], texts: int, total: int, kinds: int, leaves: int):
        own = min(leaves, len(head))
        self.total, self.kinds, self.texts = total + texts, kinds + (texts > 0), texts
        self.groups = max(1, round(math.sqrt(own)))
        self.own = -(-own // self.groups)
        self.size = self.own + HASHED
        order = sorted(range(own), key=lambda i: head[i][0][::-1])
        self.bounds = [head[order[i]][0][::-1] for i in range(self.own, own, self.own)] if own else []
        self.groups = len(self.bounds) + 1
        self.last = np.array([int.from_bytes(x[:8].ljust(8, b"\0"), "big") for x in self.bounds], dtype=np.uint64)
        #: The end of a text, and what stands before a text.
        self.end = self.groups * self.size
        self.before = self.end + 1
        place = {x: i for i, x in enumerate(order)}
        self.leaf = np.empty(len(head), dtype=np.int32)
        for i, (w, _) in enumerate(head):
            at = place.get(i, -1)
            self.leaf[i] = at // self.own * self.size + at % self.own if at >= 0 else self.hashed(w)
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.n = np.array([c for _, c in head], dtype=np.float64)
        self.alone = np.zeros(self.end, dtype=bool)
        self.alone.reshape(self.groups, self.size)[:, : self.own] = True
        self.bottom = math.log10(self.total + self.kinds + 1)
        #: The places of the head's words, made where texts are coded.
        self.places: Places | None = None
        self.learn(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))

    def hashed(self, word: bytes) -> int:
        """The leaf of a word outside the head."""
        return bisect_right(self.bounds, word[::-1]) * self.size + self.own + zlib.crc32(word) % HASHED

    def all_hashed(self, words: list[bytes], cut: Cut, at: np.ndarray) -> np.ndarray:
        """hashed() of many words, those of a cut at places.

        Read as one number, the last eight bytes of words, 0 before a shorter one, have the order of words read backwards; where
        a bound has the same eight, bytes before them decide.
        """
        n = cut.end[at] - cut.begin[at]
        last = cut.eights(cut.end[at] - np.minimum(n, 8), n) << (8 * np.maximum(8 - n, 0)).astype(np.uint64)
        group = np.searchsorted(self.last, last, side="right")
        for i in np.flatnonzero(np.append(np.uint64(0), self.last)[group] == last).tolist() if self.bounds else ():
            group[i] = bisect_right(self.bounds, words[i][::-1])
        return group * self.size + self.own + np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % HASHED

    def learn(self, leaf: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> None:
        """Take in the sums of the words outside the head, by leaf; n and kinds may be partial sums."""
        n = np.bincount(leaf, n, self.end) + np.bincount(self.leaf, self.n, self.end)
        kinds = np.bincount(leaf, kinds, self.end) + np.bincount(self.leaf, minlength=self.end)
        #: What the share of a word in its leaf is divided by: 1 + its count over this, or 1.
        self.bottoms = np.where(self.alone, 0.0, np.log10(n + kinds + 1))
        p = np.where(self.alone, n, n + 1).reshape(self.groups, self.size)
        of_group = np.append(p.sum(axis=1), self.texts + 1)
        self.group_share = of_group / of_group.sum()
        self.leaf_share = p / p.sum(axis=1, keepdims=True)

    def coded(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Leaves of all texts, each after SPAN signs of its beginning; head places (-1 outside, -2 else);
        where each text begins and its end is; and the words outside the head, with the text of each."""
        if self.places is None:
            self.places = Places(list(self.index))
        cut = Cut(texts)
        sizes, n = cut.sizes, len(cut.begin)
        ends = np.cumsum(sizes + SPAN + 1) - 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(n) + SPAN + owner * (SPAN + 1)
        places = self.places.of(cut)
        outside = np.flatnonzero(places < 0)
        words = cut.words(outside)
        leaves = self.leaf[places] if len(self.leaf) else np.empty(n, dtype=np.int32)
        leaves[outside] = self.all_hashed(words, cut, outside)
        size = int(ends[-1]) + 1 if len(ends) else 0
        ids, place = np.full(size, self.before, dtype=np.int32), np.full(size, -2, dtype=np.int64)
        ids[at], ids[ends], place[at] = leaves, self.end, places
        return ids, place, ends - sizes, ends, owner[outside], words


def stretches(ids: np.ndarray, before: int) -> np.ndarray:
    """Rows of SPAN + LENGTH leaves, each with the SPAN before its own LENGTH; ids begin with SPAN that count for none."""
    n = max(0, -(-(len(ids) - SPAN) // LENGTH))
    whole = np.concatenate([ids, np.full(n * LENGTH + SPAN - len(ids), before, dtype=np.int32)])
    return np.lib.stride_tricks.sliding_window_view(whole, LENGTH + SPAN)[::LENGTH]


def rows_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at], by the way that is fast for short rows."""
    return np.take(x, at, axis=0)


def window_sums(x: np.ndarray) -> np.ndarray:
    """Sums of each SPAN - 1 successive places (axis 1), from sums of 1, 2, 4 and so on."""
    out, left, at, part, width = None, SPAN - 1, 0, x, 1
    n = x.shape[1] - left + 1
    while left:
        if left & 1:
            out = part[:, at : at + n].copy() if out is None else np.add(out, part[:, at : at + n], out=out)
            at += width
        left >>= 1
        if left:
            part = part[:, :-width] + part[:, width:]
            width *= 2
    return out


class Model:
    """near, far: vectors of leaves as contexts; leaf, group: vectors as targets; *_b: their biases."""

    NAMES = ("near", "far", "leaf", "leaf_b", "group", "group_b")

    def __init__(self, words: Words, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.groups, self.size, self.end, self.before = words.groups, words.size, words.end, words.before
        self.group_share, self.leaf_share = words.group_share, words.leaf_share
        shapes = {"near": self.before + 1, "far": self.before + 1, "leaf": self.end, "group": self.groups + 1}
        self.p = {k: rng.normal(0, 0.1, (n, DIM)).astype(_F) for k, n in shapes.items()}
        with np.errstate(divide="ignore"):
            self.p["leaf_b"] = np.maximum(np.log(self.leaf_share), -30).astype(_F).ravel()
            self.p["group_b"] = np.log(self.group_share).astype(_F)
        self.grown = {k: np.full(len(v), 1e-6, dtype=_F) for k, v in self.p.items()}

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """h of each of the LENGTH targets of stretches."""
        out = np.empty((len(ids), LENGTH, DIM), dtype=_F)
        for lo in range(0, len(ids), 16):  # few enough for a core's cache
            part = ids[lo : lo + 16]
            far = window_sums(rows_of(self.p["far"], part[:, : LENGTH + SPAN - 2]))
            np.add(far, rows_of(self.p["near"], part[:, SPAN - 1 : -1]), out=out[lo : lo + 16])
        return out

    def with_one(self, ids: np.ndarray, live: np.ndarray) -> np.ndarray:
        """h of some targets of stretches, and a last column of 1."""
        h = np.ones((len(live), DIM + 1), dtype=_F)
        h[:, :DIM] = rows_of(self.hidden(ids).reshape(-1, DIM), live)
        return h

    def _step(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        """One Adagrad step by the sum of the gradients g of each row."""
        p, grown = self.p[name], self.grown[name]
        self.mark[rows] = True
        own = np.flatnonzero(self.mark[: len(p)])
        self.mark[own] = False
        self.place[own] = np.arange(len(own))
        at, n = np.take(self.place, rows), len(own)
        if g.ndim > 1:
            total, columns = np.empty((DIM, n), dtype=_F), np.empty((DIM, len(g)), dtype=_F)
            for lo in range(0, len(g), 256):  # few enough for a core's cache
                columns[:, lo : lo + 256] = g[lo : lo + 256].T
            for j, column in enumerate(columns):
                total[j] = np.bincount(at, column, n)
            now = np.take(grown, own) + np.einsum("ij,ij->j", total, total) / DIM
        else:
            total = np.bincount(at, g, n).astype(_F)
            now = np.take(grown, own) + total * total
        grown[own] = now
        p[own] = rows_of(p, own) - (total * (rate / np.sqrt(now))).T

    def _sorted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which targets of stretches count, in the order of their groups; their leaves; their groups."""
        target = ids[:, SPAN:].ravel()
        live = np.flatnonzero(target != self.before)
        group = np.minimum(target[live] // self.size, self.groups)
        order = np.argsort(group.astype(np.int16) if self.groups < 32_000 else group, kind="stable")
        return live[order], target[live[order]], group[order]

    def prepare(self) -> None:
        """Work space of training."""
        self.mark, self.place = np.zeros(self.before + 1, dtype=bool), np.empty(self.before + 1, dtype=np.int64)
        #: Cumulative shares, the leaves of group g between g and g + 1.
        self.steps = (np.cumsum(self.leaf_share, axis=1) / np.maximum(self.leaf_share.sum(axis=1, keepdims=True), 1e-300) + np.arange(self.groups)[:, None]).ravel()
        self.group_steps = np.cumsum(self.group_share)
        with np.errstate(divide="ignore"):
            self.leaf_log = np.maximum(np.log(NOISE_LEAVES * self.leaf_share), -30).astype(_F).ravel()
            self.group_log = np.log(NOISE_GROUPS * self.group_share).astype(_F)

    def train(self, ids: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One mini-batch of stretches."""
        p, last = self.p, self.groups
        live, target, group = self._sorted(ids)
        if not len(live):
            return
        h = self.with_one(ids, live)  # so that products hold the biases, and their gradients
        weight = _F(1 / len(live))

        def false_g(less: np.ndarray) -> np.ndarray:
            """The gradient of noise scores, given with the sign turned, in their place; an overflow is a gradient of 0."""
            with np.errstate(over="ignore"):
                np.exp(less, out=less)
            less += 1
            return np.divide(weight, less, out=less)

        def true_g(less: np.ndarray) -> np.ndarray:
            return false_g(less) - weight

        def turned(vectors: np.ndarray, biases: np.ndarray) -> np.ndarray:
            return np.negative(np.concatenate([vectors, biases[..., None]], axis=-1))

        def joined(scale: np.ndarray, rows: np.ndarray, more: np.ndarray) -> np.ndarray:
            """Gradients scale * rows, and more below them."""
            out = np.empty((len(rows) + len(more), DIM), dtype=_F)
            np.multiply(scale[:, None], rows, out=out[: len(rows)])
            out[len(rows) :] = more
            return out

        cuts = np.searchsorted(group, np.arange(last + 2)).tolist()  # targets are in the order of their groups
        there = [(g, lo, hi) for g, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
        noise = np.minimum(np.searchsorted(self.group_steps, rng.random(NOISE_GROUPS), side="right"), last)
        less = self.group_log - p["group_b"]
        g_h, vectors = rows_of(p["group"], group), p["group"][noise]
        g_true = true_g(np.take(less, group) - np.einsum("ij,ij->i", h[:, :DIM], g_h))
        g_false = false_g(h @ turned(vectors, -less[noise]).T)
        g_h *= g_true[:, None]
        g_h += g_false @ vectors
        g_group = np.empty((len(there) + len(noise), DIM + 1), dtype=_F)
        for at, (_, lo, hi) in enumerate(there):
            np.matmul(g_true[lo:hi], h[lo:hi], out=g_group[at])
        np.matmul(g_false.T, h, out=g_group[len(there) :])
        rows = np.concatenate([np.array([g for g, _, _ in there]), noise])
        steps = [("group", rows, g_group[:, :DIM]), ("group_b", rows, g_group[:, DIM])]

        m = cuts[last]
        if m:
            inner, leaf = h[:m], target[:m]
            there = [x for x in there if x[0] < last]
            noise = np.searchsorted(self.steps, rng.random((last, NOISE_LEAVES)) + np.arange(last)[:, None], side="right")
            noise = np.minimum(noise, (np.arange(1, last + 1) * self.size - 1)[:, None])
            vectors = rows_of(p["leaf"], noise)
            others = turned(vectors, np.take(p["leaf_b"], noise) - np.take(self.leaf_log, noise))
            score = np.empty((m, NOISE_LEAVES), dtype=_F)
            for g, lo, hi in there:
                np.matmul(inner[lo:hi], others[g].T, out=score[lo:hi])
            g_inner = rows_of(p["leaf"], leaf)
            g_true = true_g(np.take(self.leaf_log, leaf) - np.take(p["leaf_b"], leaf) - np.einsum("ij,ij->i", inner[:, :DIM], g_inner))
            g_false = false_g(score)
            g_noise = np.zeros((last, NOISE_LEAVES, DIM + 1), dtype=_F)
            g_inner *= g_true[:, None]
            g_h[:m] += g_inner
            for g, lo, hi in there:
                part = g_false[lo:hi]
                g_h[lo:hi] += part @ vectors[g]
                np.matmul(part.T, inner[lo:hi], out=g_noise[g])
            met = np.array([g for g, _, _ in there])
            rows, more = np.concatenate([leaf, noise[met].ravel()]), g_noise[met].reshape(-1, DIM + 1)
            steps += [("leaf", rows, joined(g_true, inner[:, :DIM], more[:, :DIM])), ("leaf_b", rows, np.concatenate([g_true, more[:, DIM]]))]

        back = np.zeros((len(ids) * LENGTH, DIM), dtype=_F)
        back[live] = g_h
        steps.append(("near", ids[:, SPAN - 1 : -1].ravel(), back))
        around = np.zeros((len(ids), LENGTH + 2 * SPAN - 4, DIM), dtype=_F)
        around[:, SPAN - 2 : SPAN - 2 + LENGTH] = back.reshape(len(ids), LENGTH, DIM)
        far = window_sums(around)  # by places; the targets 2 to SPAN places on learn from each
        steps.append(("far", ids[:, : LENGTH + SPAN - 2].ravel(), far.reshape(-1, DIM)))
        for name, rows, g in steps:
            self._step(name, rows, g, rate)

    @staticmethod
    def _halves(vectors: np.ndarray, biases: np.ndarray) -> np.ndarray:
        """Rows whose products with (h, 1) are (1 + y) / 2, where 2 ** HALVINGS * y = h . vector + bias + SHIFT."""
        times = 0.5 ** (HALVINGS + 1)
        return np.concatenate([vectors * _F(times), ((biases.astype(np.float64) + SHIFT) * times + 0.5).astype(_F)[..., None]], axis=-1)

    @staticmethod
    def _logs(h: np.ndarray, halves: np.ndarray, vectors: np.ndarray, biases: np.ndarray, target: np.ndarray, bounded: bool) -> np.ndarray:
        """Logarithm of each target's share after h, whose last column is 1.

        exp takes longer than all else here, so it is the Taylor polynomial of y, of degree 4, squared HALVINGS times;
        with s = (1 + y) / 2 that polynomial is 2 / 3 of (s * s + 3 / 4) ** 2 + s. Where a sum lies in USUAL, no
        h . vector + bias is above the logarithm of its end, which keeps the relative error of the sum below 3e-5 (of up to 700
        terms, rounding apart), and some 1e-6 as a rule. Other rows, and all where h and vectors are so long that y could be below -2, take exp itself.
        """
        s = h @ halves.T
        found = np.take(s.ravel(), np.arange(0, s.size, s.shape[1]) + target).astype(np.float64) * 2.0 ** (HALVINGS + 1) - (2**HALVINGS + SHIFT)
        if not bounded:
            sums, exact = np.empty(len(s)), np.arange(len(s))
        else:
            x = np.square(s)
            x += _F(0.75)
            np.square(x, out=x)
            x += s
            for _ in range(HALVINGS - 1):
                np.square(x, out=x)
            sums = np.log(np.vecdot(x, x), dtype=np.float64) - (2**HALVINGS * math.log(1.5) + SHIFT)
            exact = np.flatnonzero(~((sums > USUAL[0]) & (sums < USUAL[1])))
        if len(exact):
            z = h[exact, :DIM] @ vectors.T + biases
            found[exact] = z[np.arange(len(exact)), target[exact]]
            top = z.max(axis=1)
            sums[exact] = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
        return found - sums

    def log10(self, ids: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of the leaf of each target of stretches; 0 where nothing counts."""
        out = np.zeros(len(ids) * LENGTH)
        leaf, leaf_b = self.p["leaf"].reshape(self.groups, self.size, DIM), self.p["leaf_b"].reshape(self.groups, self.size)
        group, group_b = self.p["group"], self.p["group_b"]
        group_s, leaf_s = self._halves(group, group_b), self._halves(leaf, leaf_b)
        #: h up to this length leave no y below -2.
        low = min(group_b.min(), leaf_b.min(initial=0.0)) + SHIFT + 2.0 ** (HALVINGS + 1)
        length = low / max(1e-30, *(float(np.einsum("...j,...j->...", v, v).max(initial=0.0)) ** 0.5 for v in (group, leaf)))
        step = 8 * BATCH
        for start in range(0, len(ids), step):
            part = ids[start : start + step]
            live, target, of = self._sorted(part)
            h = self.with_one(part, live)
            bounded = bool(np.einsum("ij,ij->i", h[:, :DIM], h[:, :DIM]).max(initial=0.0) ** 0.5 <= length)
            found = np.empty(len(live))
            for lo in range(0, len(live), ROWS):
                rows = slice(lo, lo + ROWS)
                found[rows] = self._logs(h[rows], group_s, group, group_b, of[rows], bounded)
            cuts = np.searchsorted(of, np.arange(self.groups + 1)).tolist()
            for g, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                for at in range(lo, hi, ROWS):
                    rows = slice(at, min(at + ROWS, hi))
                    found[rows] += self._logs(h[rows], leaf_s[g], leaf[g], leaf_b[g], target[rows] - g * self.size, bounded)
            out[start * LENGTH + live] = found
        return out / math.log(10)


def _learn(batches: Iterator[pa.RecordBatch], sent, turn: int, rate: float, times: int) -> Iterator[pa.RecordBatch]:
    """Train on a task's texts; slabs of rows of the model, with what has been learned about each row.

    Texts are read more than once only where there are fewer than LEAST tokens; then all are held.
    """
    words, given = sent[0].value, sent[1].value
    model = copy(given)  # a worker may run several tasks of this round
    model.p, model.grown, before = {k: v.copy() for k, v in given.p.items()}, {k: v.copy() for k, v in given.grown.items()}, given.grown
    model.prepare()
    rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
    held: list[np.ndarray] = []

    def spend(rows: np.ndarray) -> None:
        rows = rows[rng.permutation(len(rows))]
        for lo in range(0, len(rows), BATCH):
            model.train(rows[lo : lo + BATCH], rng, rate)

    met = False
    for batch in small_batches(batches, "__text", 2_000_000):
        met = True
        held.append(stretches(words.coded(column_bytes(batch.column("__text")))[0], words.before))
        if times == 1 and sum(map(len, held)) >= CHUNK:
            spend(np.concatenate(held))
            held = []
    if held:
        whole = np.concatenate(held)
        for _ in range(times):
            spend(whole)
    if not met:
        return
    for name in Model.NAMES:
        p, learned = model.p[name], model.grown[name] - before[name]
        for lo in range(0, len(p), SLAB):
            if learned[lo : lo + SLAB].any():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lo], pa.int64()), pa.array([p[lo : lo + SLAB].astype(np.float16).tobytes()], pa.binary()), pa.array([learned[lo : lo + SLAB].tobytes()], pa.binary())], names=["name", "lo", "rows", "learned"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each slab: rows averaged by what their trainers learned, and the mean of that."""
    now, rows, learned, squares = None, None, None, None

    def made() -> pa.RecordBatch:
        total = np.maximum(learned, 1e-30)
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([(rows / total[:, None]).astype(_F).tobytes()], pa.binary()), pa.array([(squares / total).astype(_F).tobytes()], pa.binary())], names=["name", "lo", "rows", "learned"])

    for batch in batches:
        for name, lo, r, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
            w = np.frombuffer(w, dtype=_F).astype(np.float64)
            r = np.frombuffer(r, dtype=np.float16).reshape(len(w), -1).astype(np.float64) * w[:, None]
            if (name, lo) != now:
                if now is not None:
                    yield made()
                now, rows, learned, squares = (name, lo), r, w, w * w
            else:
                rows, learned, squares = rows + r, learned + w, squares + w * w
    if now is not None:
        yield made()


def fit(train: DataFrame, words: Words) -> Model:
    """Train on the column __text of all rows of train."""
    spark = train.sparkSession
    model = Model(words)
    if not words.total:
        return model
    passes = min(PASSES, max(1, math.ceil(LEAST / words.total)))
    slices, times = math.ceil(ROUNDS / passes), math.ceil(passes / ROUNDS)
    rounds = math.ceil(passes / times) * slices
    trainers = max(1, round(math.sqrt(words.total / TOKENS)))
    dealt = train.coalesce(trainers) if train.rdd.getNumPartitions() >= trainers else train.repartition(trainers)
    words_sent = spark.sparkContext.broadcast(words)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        rate = RATE * (1 - 0.9 * turn / rounds)
        mine = dealt if slices == 1 else dealt.filter(F.pmod(F.xxhash64("__text"), F.lit(slices)) == turn % slices)
        schema = "name string, lo long, rows binary, learned binary"
        learned = mine.mapInArrow(lambda b, sent=(words_sent, sent), turn=turn, rate=rate: _learn(b, sent, turn, rate, times), schema)
        # Slabs of the averaged model: as many bytes as the model has, whatever the number of trainers.
        for r in learned.repartition("name", "lo").sortWithinPartitions("name", "lo").mapInArrow(_average, schema).collect():
            w = np.frombuffer(r.learned, dtype=_F)
            rows = slice(r.lo, r.lo + len(w))
            p, grown = model.p[r["name"]], model.grown[r["name"]]
            p[rows] = np.where((w > 0).reshape(-1, *[1] * (p.ndim - 1)), np.frombuffer(r.rows, dtype=_F).reshape(p[rows].shape), p[rows])
            grown[rows] += w
        sent.destroy()
    words_sent.destroy()
    return model


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    words, model = sent.value
    uid = TaskContext.get().partitionId() << 40
    kinds = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "tf"]
    base = np.append(np.log10(words.n + 1) - words.bottom, [math.log10(words.texts + 1) - words.bottom, -words.bottom])  # places -2 and -1 are the last two
    for batch in small_batches(batches, "__text", 1_000_000):
        kinds[1] = batch.schema.field("doc_id").type
        ids, place, begins, ends, owner, outside = words.coded(column_bytes(batch.column("__text")))
        p = model.log10(stretches(ids, words.before))[: len(ids) - SPAN]
        p = np.concatenate([np.zeros(SPAN), p])
        shared = np.flatnonzero((place >= -1) & (ids < words.end))
        shared = shared[~words.alone[ids[shared]]]
        p[shared] -= words.bottoms[ids[shared]]
        of_head = shared[place[shared] >= 0]
        p[of_head] += np.log10(words.n[place[of_head]] + 1)
        own = np.where(ids == words.before, 0.0, base[place])
        known = (place >= 0) | ((ids == words.end) & (words.texts > 0))
        n = len(begins)
        uids = np.arange(uid, uid + n)
        uid += n
        sums = lambda x: np.add.reduceat(x, begins)  # noqa: E731 - what stands before a text is 0
        heads = [uids, batch.column("doc_id"), batch.column("held_out"), ends - begins + 1, sums(known.astype(np.int64)), sums(own), sums(p)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, t) if isinstance(x, np.ndarray) else x for x, t in zip(heads, kinds)], pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
        if outside:
            times = np.ones(len(outside), dtype=np.int64)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            if (np.diff(cuts) > 1000).any():  # in a long text, equal words are one row
                counted = Counter(zip(owner.tolist(), outside))
                owner, outside = np.array([i for i, _ in counted]), [w for _, w in counted]
                times = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
            m = len(outside)
            yield pa.RecordBatch.from_arrays([pa.array(uids[owner]), *[pa.nulls(m, t) for t in kinds[1:7]], pa.array(outside, pa.binary()), pa.array(times)], names=names)


def _leaf_sums(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    words = sent.value
    n, kinds = np.zeros(words.end), np.zeros(words.end)
    for batch in batches:
        word, count = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        out = np.fromiter((w not in words.index for w in word), dtype=bool, count=len(word))
        outside = [w for w, o in zip(word, out) if o]
        leaf = words.all_hashed(outside, Cut(outside), np.arange(len(outside)))
        n += np.bincount(leaf, count[out], words.end)
        kinds += np.bincount(leaf, minlength=words.end)
    leaf = np.flatnonzero(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n[leaf]), pa.array(kinds[leaf])], names=["leaf", "n", "kinds"])


def learn(train: DataFrame, leaves: int | None = None, head: int | None = None) -> tuple[Words, Model, DataFrame]:
    """Word statistics, the model and the table of all word counts (word, n) of train's column __text."""
    spark = train.sparkSession
    ship(spark)
    counts = table(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds")).first()
    grown = sizes(total.kinds)
    leaves, head = leaves or grown[0], head or grown[1]
    top = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()  # head rows at most
    top = [x for x in zip(top.column("word").to_pylist(), top.column("n").to_pylist()) if len(x[0]) <= 200]
    words = Words(top, train.count(), total.n, total.kinds, leaves)
    if total.kinds > len(words.index):
        sent = spark.sparkContext.broadcast(words)
        sums = counts.mapInArrow(lambda b: _leaf_sums(b, sent), "leaf long, n double, kinds double").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
        found = sums.collect()  # one row for each hashed leaf at most
        words.learn(*(np.array([r[c] for r in found], dtype=t) for c, t in (("leaf", np.int64), ("n", np.float64), ("kinds", np.float64))))
    return words, fit(train, words), counts


def apply(source: DataFrame, words: Words, model: Model, counts: DataFrame) -> DataFrame:
    """The scores of source (doc_id, held_out, __text)."""
    sent = source.sparkSession.sparkContext.broadcast((words, model))
    source = spread(source)
    schema = T.StructType([T.StructField("uid", T.LongType()), source.schema["doc_id"], *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long").fields])
    schema["doc_id"].nullable = True
    scored = table(source.mapInArrow(lambda b: _score(b, sent), schema), "scored")
    heads = scored.filter("word is null").drop("word", "tf")
    rest = scored.filter("word is not null").select("uid", "word", "tf").join(counts, "word", "left")
    # Only the logarithm of the count is missing so far, from base and score alike.
    rest = rest.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)).cast("double") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return heads.join(rest, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def scores(docs: DataFrame, text: str = "text", modulus: int = 7, leaves: int | None = None, head: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Rows whose crc32(doc_id as text) leaves remainder 2 modulo ``modulus`` are held out; the
    model and the base learn from the others. Unless given, leaves and head grow with the words.
    """
    source = docs.select("doc_id", held_out("doc_id", modulus).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return apply(source, *learn(source.filter(~F.col("held_out")).select("__text"), leaves, head))
