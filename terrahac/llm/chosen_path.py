"""Near-duplicate documents: a chosen-path join on the Jaccard similarity of word shingles.

Documents with equal shingle sets form a class; the join runs over classes.

Candidates. A class carries a minhash sketch, whose coordinates are shared samples of its
set's tokens. A run splits the classes recursively: a node of the recursion chooses BRANCHES
coordinates, and classes go to the child of each coordinate's value. A pair at the threshold
t stays together in some child of a node with probability 1 - (1 - t p)^BRANCHES, where p is
the same for the child; the limit of this recursion and the recall asked for give the number
of runs. Nodes of at most ``leaf`` classes are compared by their sketches, leaving a wide
margin. A larger node is split again, until a child keeps nearly all of its parent, so that
its classes are alike and splitting is in vain; then, and below DEPTH, its classes stay
together without a comparison. Of each node only edges that span it are kept, never all
pairs.

Verification. Candidate edges are grouped into clusters, and each cluster compares the exact
sets of all its classes, in tiles of bounded size; so a pair that a run has missed is still
found if its cluster holds together. A tile gives each class its number of links and edges
that span what is linked.

Defined results: class_id is the smallest id of the documents that links and copies connect
(links are not closed under transitivity, so a class may hold documents below the
threshold); n_links counts the other documents at the threshold or above, copies included.
A text of fewer words than a shingle, but not none, is one shingle; a text without words has
no links and is a class of its own. Rows with a null id take no part: their class_id is
null. Repeated rows are copies of each other. Extra columns are ignored, and an empty table gives
no rows. Ids are whole numbers; other ids raise Spark's error of the cast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahac.llm.common import column_bytes, drop_table, ship, small_batches, sorted_groups, table
from terrahac.llm.components import SEND_NODES, components
from terrahac.llm.words import _U, mix, shingle_sets

COORDS = 64
BRANCHES = 2
LEAF = 128
DEPTH = 8
#: A child that keeps this share of its parent's classes is not split further.
DENSE = 0.75
#: Sketches this far below the threshold (about four standard deviations) are not compared exactly.
MARGIN = 0.2
#: Classes and shingles of a block; a tile is two blocks.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Size, as a power of two, of the table of bits that documents are screened by.
BITS = 24

_A = mix(np.arange(1, COORDS + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
_B = mix(np.arange(1, COORDS + 1, dtype=_U) * _U(0xAF251AF3B0F025B5))


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is found with probability recall, however deep the recursion."""
    p = 1.0
    for _ in range(1000):
        p = 1 - (1 - threshold * p) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _sketch(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of COORDS minima; starts: where each set begins, with the end; sets are not empty."""
    out = np.empty((len(starts) - 1, COORDS), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(COORDS):
            out[:, j] = np.minimum.reduceat(((sets * _A[j] + _B[j]) >> _U(32)).astype(np.uint32), starts[:-1])
    return out


def _names(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, 0 for the empty one."""
    full = np.flatnonzero(np.diff(starts))
    out = [np.zeros(len(starts) - 1, dtype=np.int64) for _ in range(2)]
    if len(full):
        with np.errstate(over="ignore"):
            for k, a in zip(out, _A):
                k[full] = np.add.reduceat(mix(sets ^ a), starts[full]).view(np.int64)
    return out[0], out[1]


def sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """doc_id, the 128-bit name of its shingle set (k1, k2; null if it has none) and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", 600_000):
            sets, starts, _ = shingle_sets(column_bytes(batch.column("__text")), shingle)
            full = np.flatnonzero(np.diff(starts))
            k1, k2 = _names(sets, starts)
            sk = [None] * len(k1)
            if len(full):
                for i, row in zip(full, _sketch(sets, np.append(starts[full], len(sets)))):
                    sk[i] = row.tobytes()
            none = np.diff(starts) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(sk, pa.binary())], names=["doc_id", "k1", "k2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(run, "doc_id long, k1 long, k2 long, sketch binary")


def _children(paths: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (a node's path and a class's sketch) its BRANCHES children; rows repeat."""
    with np.errstate(over="ignore"):
        rows = np.repeat(np.arange(len(paths)), BRANCHES)
        p = paths[rows]
        first = mix(p) % _U(COORDS)
        turn = np.tile(np.arange(BRANCHES, dtype=_U), len(paths))
        j = (first + turn * (_U(1) + mix(p ^ _A[2]) % _U(COORDS // BRANCHES - 1))) % _U(COORDS)
        value = sk[rows, j.astype(np.int64)].astype(_U)
        return rows, mix(mix(p + j + _U(1)) * _A[3] + value)


def _roots(run: int, sk: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(mix(np.full(len(sk), run * BRANCHES + b + 1, dtype=_U)) * _A[4] + sk[:, (run * BRANCHES + b) % COORDS].astype(_U)) for b in range(BRANCHES)]


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), COORDS)


def _split_roots(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "sketch", 1_000_000):
        sk = _matrix(column_bytes(batch.column("sketch")))
        node = batch.column("node").to_numpy()
        for r in range(runs):
            for paths in _roots(r, sk):
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(node)], names=["path", "node"])


def _split_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "sketch", 1_000_000):
        rows, paths = _children(batch.column("path").to_numpy().view(_U), _matrix(column_bytes(batch.column("sketch"))))
        node, size = batch.column("node").to_numpy()[rows], batch.column("size").to_numpy()[rows]
        yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(node), pa.array(size)], names=["path", "node", "parent"])


class Sets:
    """Which members of a small universe are joined so far."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def stars(self, names: list[int]) -> list[tuple[int, int]]:
        """Each member with the smallest name it is joined to, if that is another's."""
        low: dict[int, int] = {}
        for i, x in enumerate(names):
            low[self.find(i)] = min(low.get(self.find(i), x), x)
        return [(x, low[self.find(i)]) for i, x in enumerate(names) if x != low[self.find(i)]]


def _leaf_edges(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stars that span what is alike in each leaf."""
    a, b = [], []
    for _, rows in sorted_groups(batches, ["path"], ["node", "sketch"]):
        node, sk = rows["node"], _matrix(rows["sketch"])
        sets = Sets(len(node))
        for i in range(len(node) - 1):
            for j in np.flatnonzero((sk[i + 1 :] == sk[i]).sum(axis=1) >= least):
                sets.join(i, i + 1 + int(j))
        for x, y in sets.stars(node):
            a.append(x)
            b.append(y)
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_edges(classes: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """Edges (a, b) between classes (node, sketch) that connect all pairs a run has found."""
    runs = runs_for(threshold, recall)
    sketch = classes.select("node", "sketch")
    members = sketch.mapInArrow(lambda x: _split_roots(x, runs), "path long, node long").withColumn("parent", F.lit(None).cast("long"))
    least = max(1, math.floor((threshold - MARGIN) * COORDS))
    small = stars = None
    for depth in range(DEPTH):
        # A node's classes are counted before they meet; those alone in theirs go no further. Where a node has more
        # than a leaf's classes they are told so by a table that all tasks get, and meet nothing in the shuffle, where
        # they are dealt by themselves; so no more than a leaf's classes meet at a path.
        sizes = table(members.groupBy("path").agg(F.count("*").alias("size"), F.min("node").alias("hub"), F.max("parent").alias("whole")).filter("size > 1"), "sizes")
        crowded = sizes.filter(F.col("size") > leaf)
        sent = F.broadcast if crowded.count() <= SEND_NODES else lambda x: x
        told = members.select("path", "node").join(sent(crowded), "path", "left")
        told = told.withColumn("key", F.when(F.col("size").isNull(), F.col("path")).otherwise(F.xxhash64("node", "path")))
        few = sizes.filter(F.col("size") <= leaf).select(F.col("path").alias("key"), F.lit(True).alias("few"))
        sized = table(told.join(few, "key", "left").filter("size is not null or few").drop("key", "few"), "nodes")
        drop_table(sizes)
        leaves = sized.filter("size is null").select("path", "node")
        big = sized.filter("size is not null")
        dense = F.coalesce(F.col("size") >= DENSE * F.col("whole"), F.lit(False)) if depth < DEPTH - 1 else F.lit(True)
        alike = big.filter(dense & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        small, stars = (leaves, alike) if small is None else (small.unionByName(leaves), stars.unionByName(alike))
        deeper = big.filter(~dense)
        if deeper.isEmpty():
            break
        members = table(deeper.select("path", "node", "size").join(sketch, "node").mapInArrow(_split_nodes, "path long, node long, parent long"), "members")
    found = small.join(sketch, "node").repartition("path").sortWithinPartitions("path").mapInArrow(lambda x: _leaf_edges(x, least), "a long, b long")
    return found.unionByName(stars)


def _bits_of(ids: DataFrame) -> np.ndarray:
    """A table of 2**BITS bits with those of all ids set: of one size, whatever the number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy())] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << BITS, dtype=bool)
    for row in ids.coalesce(8).mapInArrow(run, "bits binary").collect():  # 8 rows at most
        out |= np.unpackbits(np.frombuffer(row.bits, dtype=np.uint8)).astype(bool)
    return out


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - BITS)).astype(np.int64)


def _shingled(batches: Iterator[pa.RecordBatch], shingle: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Names and shingles of the documents whose ids have their bits set."""
    for batch in small_batches(batches, "__text", 600_000):
        batch = batch.filter(batch.column("rep").is_valid())
        batch = batch.filter(pa.array(bits[_bit(batch.column("rep").to_numpy())]))
        sets, starts, _ = shingle_sets(column_bytes(batch.column("__text")), shingle)
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))
        k1, k2 = _names(sets, starts)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(k1), pa.array(k2), lists], names=["rep", "k1", "k2", "shingles"])


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    every = np.concatenate(a + b)
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    twice = count[which] > 1
    owner, which = owner[twice], which[twice]
    _, which = np.unique(which, return_inverse=True)
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    width = 1 << 12
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        part = slice(*np.searchsorted(which, [lo, lo + width]))
        dense = np.zeros((len(a) + len(b), width), dtype=np.float32)
        dense[owner[part], which[part] - lo] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out


def _tiles(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """(node, other, links): links of a node, with other null; or an edge."""
    out: list[tuple] = []
    for (_, first, second), rows in sorted_groups(batches, ["cluster", "first", "second"], ["node", "copies", "shingles", "block"]):
        once = list({x: i for i, x in enumerate(rows["node"])}.values())  # a repeated row of the document that stands for a class
        rows = {k: [v[i] for i in once] for k, v in rows.items()}
        sets = [np.array(x, dtype=np.int64) for x in rows["shingles"]]
        node, copies = rows["node"], np.array(rows["copies"], dtype=np.int64)
        left = [i for i, b in enumerate(rows["block"]) if b == first]
        right = left if first == second else [i for i, b in enumerate(rows["block"]) if b == second]
        if not left or not right:
            continue
        n = np.array([len(x) for x in sets], dtype=np.int64)
        both = np.rint(_shared([sets[i] for i in left], [sets[i] for i in right])).astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - both
        linked = both * threshold.denominator >= union * threshold.numerator
        if first == second:
            np.fill_diagonal(linked, False)
        sums = linked @ copies[right]
        out += [(node[i], None, int(s)) for i, s in zip(left, sums) if s]
        if first != second:
            sums = copies[left] @ linked
            out += [(node[i], None, int(s)) for i, s in zip(right, sums) if s]
        joined = Sets(len(sets))
        for x, y in zip(*np.nonzero(linked)):
            joined.join(left[x], right[y])
        out += [(*edge, None) for edge in joined.stars(node)]
        if len(out) > 10_000:
            yield _tile_batch(out)
            out = []
    yield _tile_batch(out)


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "other", "links"])


def similar_documents(docs: DataFrame, text: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.9999, leaf: int = LEAF) -> DataFrame:
    """doc_id, class_id and n_links of each row of docs (doc_id and a text column)."""
    ship(docs.sparkSession)
    exact = Fraction(str(threshold))
    named = table(sketches(docs, text, shingle), "sketches")
    grouped = named.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    clusters = components(candidate_edges(classes, threshold, recall, leaf))
    members = table(clusters.join(classes.select("node", "rep", "k1", "k2", "copies"), "node").select("node", F.col("label").alias("cluster"), "rep", "k1", "k2", "copies"), "members")

    # The sets of clustered classes, made again from the text of one document of each; a
    # table of bits keeps nearly all other documents out of the join.
    bits = docs.sparkSession.sparkContext.broadcast(_bits_of(members.select("rep")))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).alias("__text"))
    sets = texts.mapInArrow(lambda x: _shingled(x, shingle, bits.value), "rep long, k1 long, k2 long, shingles array<long>")
    sets = table(sets.filter(F.size("shingles") > 0).join(members, ["rep", "k1", "k2"]).select("cluster", "node", "copies", "shingles"), "sets")
    shape = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
    shape = shape.select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = sets.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", "node", "copies", "shingles", "block", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"))
    keys = ("cluster", "first", "second")
    tiles = table(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda x: _tiles(x, exact), "node long, other long, links long"), "tiles")

    links = tiles.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(tiles.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = classes.select("node", "k1", "k2", "rep", "copies").join(links, "node", "left").join(labels, "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.filter("links is not null").groupBy("label").agg(F.min("rep").alias("lowest"))
    found = labelled.join(smallest, "label", "left").select("k1", "k2", F.coalesce("lowest", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.select("doc_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    drop_table(sets)
    there = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(there, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))
