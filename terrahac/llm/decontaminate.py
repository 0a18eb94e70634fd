"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window);
its tokens are its shingles of ``shingle`` words. Shingles are ordered by how rarely they
occur in the documents. As a window counts only where it is wholly contained, its necessary
prefix is one token, the rarest. Documents are joined on those tokens; positional bounds
give the one place where the window can lie, length bounds drop it if the document ends
before, and the words there are compared one by one.

The benchmark is read in blocks of about ``block_bytes`` of text, so that what is sent to
the tasks has a fixed bound: a long item is cut into pieces that overlap by a window less a
word, and pieces are dealt to blocks by hash. Windows are places in one array of the block's
words, so a block takes about six bytes of memory for each byte of text. More blocks mean
more scans of the documents; the first gives every row, the others rows with hits only,
which meet by a number that each row gets.

Defined results: null, empty and wordless texts have no words and no hits; items without a
word or an id take no part; items of one id are one item; repeated documents each get their
row; a result column takes the place of a kept column of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahac.llm.common import column_bytes, ship, small_batches, table
from terrahac.llm.words import _BASE, _U, hashed_words, mix, words

BLOCK_BYTES = 8_000_000
_BITS = 22

RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _BASE + hashes[i : i + n]
        return mix(out + _U(size))


class Tokens:
    """A set of 64-bit values; most others are dismissed by a table of bits."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.values >> _U(64 - _BITS)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x holds values of the set, and which."""
        at = np.flatnonzero(self.bits[x >> _U(64 - _BITS)])
        which = np.searchsorted(self.values, x[at])
        which[which == len(self.values)] = 0
        hit = self.values[which] == x[at]
        return at[hit], which[hit]


class Index:
    """The windows of a block of items, as places in one array of the block's words; equal windows are one."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        split = [words(text) for _, text in items]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        self.flat = b" ".join(w for x in split for w in x)
        ends = np.cumsum(np.fromiter((len(w) + 1 for x in split for w in x), dtype=np.int64, count=int(sizes.sum())))
        self.bytes = np.concatenate([[0], ends]).astype(np.int32 if len(self.flat) < 1 << 31 else np.int64)
        self.hashes = hashed_words([self.flat])[0]
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        n = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        begin = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())
        length = np.repeat(np.minimum(sizes, window), n)
        name = np.repeat(np.array([place[x] for x, _ in items], dtype=np.int64), n)
        self._unite(begin, length, name)
        self.sizes = sorted(set(np.minimum(shingle, self.lengths).tolist()))
        self.shingle = shingle
        self.shingles = {}
        for s in self.sizes:
            own = np.minimum(shingle, self.lengths) == s
            covered = np.zeros(len(self.hashes) + 1, dtype=np.int64)  # windows that begin, less those whose last token is past
            np.add.at(covered, self.begins[own], 1)
            np.add.at(covered, self.begins[own] + self.lengths[own] - s + 1, -1)
            every = rolled(self.hashes, s)
            self.shingles[s] = Tokens(every[np.cumsum(covered)[: len(every)] > 0])

    def _unite(self, begin: np.ndarray, length: np.ndarray, name: np.ndarray) -> None:
        """begins, lengths: of each distinct window; whose: the names of window w between bounds w and w + 1."""
        key = np.empty(len(begin), dtype=_U)
        for n in np.unique(length):
            key[length == n] = rolled(self.hashes, int(n))[begin[length == n]]
        order = np.lexsort((key, length))
        begin, length, key, name = begin[order], length[order], key[order], name[order]
        first = np.ones(len(begin), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        one = np.flatnonzero(first)[np.cumsum(first) - 1]
        for i in np.flatnonzero(~first).tolist():  # equal hashes are not yet equal words
            if self._words(int(begin[i]), int(length[i])) != self._words(int(begin[one[i]]), int(length[i])):
                one[i], first[i] = i, True
        number = np.cumsum(first) - 1
        pairs = np.unique(number[one] * max(len(self.names), 1) + name)
        self.begins, self.lengths = begin[first].astype(np.int32), length[first].astype(np.int32)
        self.whose = (pairs % max(len(self.names), 1)).astype(np.int32)
        self.bounds = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(self.begins) + 1)).astype(np.int32)

    def _words(self, begin: int, length: int) -> bytes:
        return self.flat[self.bytes[begin] : self.bytes[begin + length] - 1]

    def window(self, w: int) -> bytes:
        """The words of a window, with a space between them."""
        return self._words(int(self.begins[w]), int(self.lengths[w]))

    def items(self, w: int) -> list[str]:
        return [self.names[i] for i in self.whose[self.bounds[w] : self.bounds[w + 1]].tolist()]

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose each window's prefix: its rarest token, of equals the one of the smallest hash.

        counts: by size, tokens and how often they occur; others don't.
        """
        self.prefix = {}
        for s in self.sizes:
            values, every = self.shingles[s].values, rolled(self.hashes, s)
            n = np.zeros(len(values), dtype=np.int64)
            tokens, times = counts.get(s, (values[:0], n[:0]))
            n[np.searchsorted(values, tokens)] = times
            n = n[np.minimum(np.searchsorted(values, every), len(values) - 1)]
            own = np.flatnonzero(np.minimum(self.shingle, self.lengths) == s)
            begin, steps = self.begins[own].astype(np.int64), self.lengths[own] - s + 1
            offset = np.zeros(len(own), dtype=np.int32)
            for j in range(1, int(steps.max())):
                here, best = np.minimum(begin + j, len(every) - 1), begin + offset
                less = (n[here] < n[best]) | ((n[here] == n[best]) & (every[here] < every[best]))
                offset[less & (j < steps)] = j
            token = every[begin + offset]
            order = np.argsort(token, kind="stable")
            tokens, token = Tokens(token), token[order]
            first = np.searchsorted(token, tokens.values, side="left").astype(np.int32)
            last = np.searchsorted(token, tokens.values, side="right").astype(np.int32)
            self.prefix[s] = (tokens, first, last, offset[order], own[order].astype(np.int32))
        self.shingles = {}

    def count(self, texts: list[bytes | None], total: dict[int, np.ndarray]) -> None:
        """Add to total, by size, how often each token of the windows occurs in texts."""
        hashes, counts = hashed_words(texts)
        ends = np.repeat(np.cumsum(counts), counts)
        for s in self.sizes:
            at, which = self.shingles[s].find(rolled(hashes, s))
            found, n = np.unique(which[at + s <= ends[at]], return_counts=True)
            total[s][found] += n

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The words of each text, and all (text, first word, window) where a window lies."""
        hashes, counts = hashed_words(texts)
        ends = np.cumsum(counts)
        starts = ends - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        found = []
        for s in self.sizes:
            tokens, first, last, offset, window = self.prefix[s]
            at, which = tokens.find(rolled(hashes, s))
            for lo in range(0, len(at), 100_000):  # bounded work space, whatever the number of matches
                a, w = at[lo : lo + 100_000], which[lo : lo + 100_000]
                n = last[w] - first[w]
                place = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
                begin, win = np.repeat(a, n) - offset[place], window[place]
                doc = owner[np.repeat(a, n)]
                ok = (begin >= starts[doc]) & (begin + self.lengths[win] <= ends[doc])
                begin, win, doc = begin[ok], win[ok], doc[ok]
                for i in range(int(self.lengths[win].max(initial=0))):
                    place = np.minimum(self.begins[win] + i, len(self.hashes) - 1)
                    ok = (i >= self.lengths[win]) | (hashes[np.minimum(begin + i, len(hashes) - 1)] == self.hashes[place])
                    begin, win, doc = begin[ok], win[ok], doc[ok]
                found += zip(doc.tolist(), (begin - starts[doc]).tolist(), win.tolist())
        split: dict[int, list[bytes]] = {}
        exact = []
        for d, b, w in sorted(set(found)):
            if d not in split:
                split = {d: words(texts[d])}
            if b" ".join(split[d][b : b + int(self.lengths[w])]) == self.window(w):
                exact.append((d, b, w))
        return counts, exact


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    n_hit = last = 0
    for b, e in sorted(spans):
        n_hit += max(0, e - max(b, last))
        last = max(last, e)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _found(index: Index, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    counts, hits = index.search(texts)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for d, b, w in hits:
        spans[d].append((b, b + int(index.lengths[w])))
        items[d].update(index.items(w))
    return [(int(n), _merge(s), i) for n, s, i in zip(counts, spans, items)]


def pieces(items: DataFrame, window: int, piece_bytes: int) -> DataFrame:
    """The items (name, text), long texts cut into (name, piece) so that each window is in a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1_000_000):
            names, found = [], []
            for name, text in zip(batch.column("name").to_pylist(), column_bytes(batch.column("text"))):
                if len(text) <= piece_bytes:
                    names.append(name)
                    found.append(text)
                    continue
                w = words(text)
                ends = np.cumsum([len(x) + 1 for x in w])
                lo = 0
                while lo < len(w):
                    hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + piece_bytes, side="right")), lo + window)
                    names.append(name)
                    found.append(b" ".join(w[lo:hi]))
                    lo = len(w) if hi >= len(w) else hi - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["name", "piece"])

    return items.mapInArrow(run, "name string, piece binary")


def item_blocks(parts: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Parts of the pieces (name, piece) of about block_bytes each."""
    total = parts.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [parts] if n == 1 else [parts.filter(F.pmod(F.xxhash64("name", "piece"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 13, shingle: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs, with its kept columns.

    benchmark: item_id, text. A document is contaminated if a twentieth of its words are hit.
    """
    spark = docs.sparkSession
    ship(spark)
    made = {f.name for f in RESULT}
    keep = tuple(c for c in keep if c not in made)
    source = docs.select(*keep, F.col(text).alias("__text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text")).filter("name is not null and text is not null").distinct()

    indexes = []
    for block in item_blocks(pieces(items, window, max(1, block_bytes // 16)), block_bytes):
        index = Index(sorted((r["name"], bytes(r["piece"])) for r in block.collect()), window, shingle)  # about block_bytes of text
        counts = {}
        if index.sizes:
            sent = spark.sparkContext.broadcast(index)

            def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                index = sent.value
                total = {s: np.zeros(len(index.shingles[s].values), dtype=np.int64) for s in index.sizes}
                for batch in small_batches(batches, "__text", 1_000_000):
                    index.count(column_bytes(batch.column("__text")), total)
                for s, n in total.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, dtype=np.int32)), pa.array(index.shingles[s].values[at].view(np.int64)), pa.array(n[at])], names=["size", "token", "n"])

            found = source.select("__text").mapInArrow(count, "size int, token long, n long").groupBy("size", "token").agg(F.sum("n").alias("n")).toArrow()
            size, token, n = (found.column(c).to_numpy() for c in ("size", "token", "n"))  # tokens of this block only
            counts = {s: (token[size == s].view(_U), n[size == s]) for s in index.sizes}
            sent.destroy()
        index.order(counts)
        indexes.append(spark.sparkContext.broadcast(index))

    if len(indexes) == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "__text", 1_000_000):
                rows = [_verdict(*x) for x in _found(indexes[0].value, column_bytes(batch.column("__text")))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *_columns(rows)], names=[*keep, *[f.name for f in RESULT]])

        return source.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *RESULT]))

    # Rows get numbers, written down so that every scan sees the same; only rows with hits leave the scans but the first.
    rows = table(source.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    found = []
    for i, sent in enumerate(indexes):
        carried = [*keep, "__row"] if i == 0 else ["__row"]

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, every=i == 0, carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "__text", 1_000_000):
                rows = _found(sent.value, column_bytes(batch.column("__text")))
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[x for s in r[1] for x in s] for r in rows], pa.list_(pa.int64())), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *cols], names=[*carried, "n_words", "spans", "items"])
                yield out if every else out.filter(pa.array([bool(r[1]) for r in rows], pa.bool_()))

        found.append(rows.mapInArrow(scan, T.StructType([*[rows.schema[c] for c in carried], *made])))
    others = reduce(DataFrame.unionByName, found[1:])
    others = others.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("names"))
    merged = found[0].join(others, "__row", "left").select(
        *keep,
        "n_words",
        F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"),
        F.when(F.col("names").isNull(), F.col("items")).otherwise(F.concat("items", "names")).alias("items"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_verdict(n, list(zip(s[::2], s[1::2])), set(i)) for n, s, i in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *_columns(rows)], names=[*keep, *[f.name for f in RESULT]])

    return merged.mapInArrow(finish, T.StructType([*[docs.schema[c] for c in keep], *RESULT]))


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return [pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [()] * 5, kinds)]
