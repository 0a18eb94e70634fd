"""Exact top-k search by inner product: branch and bound over a vertical layout.

Candidates of a partition are held dimension by dimension in tiles. For a tile, partial
scores against a block of queries grow by a block of dimensions at a time; after each block,
a pair of query and candidate stays only if its partial score plus the most that the remaining
dimensions can add (the product of the two remaining masses, by Cauchy and Schwarz) reaches the
query's k-th best so far. While most pairs stay, a block is one matrix product over the candidates that
any query still needs; once fewer than LISTED of them do, the survivors are compacted into lists of pairs.
Dimensions go by falling mass. All values are integers below 2**53, so floating-point products are exact.

A query's first bound is its k-th best among SEEDS candidates, drawn by a hash of their ids: at most the
k-th best of all, so nothing is lost by it. All partitions get the same bounds.

Queries go in blocks of bounded size: each is sent to all partitions of the candidates, and
of each partition only its k best per query are shuffled.

Defined results: vectors that are null or hold a null or non-finite component take no part,
as query or candidate; vectors of different lengths are not compared; the empty vector
scores 0; ties go to the smaller id; a null id takes no part; rows with equal ids are all
candidates, except for a query of that id; equal queries are answered once; queries of one id
with different vectors share one list, of the best scores of either; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrahac.llm.common import ship, table

#: Queries of a block: 64 dimensions of 8 bytes make 1 MB.
BLOCK = 2048
TILE = 8192
STEP = 16
#: Queries that are pruned together, and the share of pairs below which they are held as lists.
GROUP, LISTED = 64, 0.4
#: Candidates that give the first bounds: at most about so many.
SEEDS = 4096


def search_tile(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], bounds: np.ndarray | None = None, dropped: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge a tile's candidates into best: scores (n x k, falling) and ids.

    queries: n x d; vectors: d x m, the vertical layout; own: the queries' ids; bounds: scores that the
    k best of each query reach. dropped, if given, gets the pairs left out before the last block of dimensions, and all pairs.
    """
    scores, found = best
    n, d = queries.shape
    m = vectors.shape[1]
    mass = (vectors * vectors).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    vectors, queries = vectors[order], queries[:, order]
    cuts = range(STEP, d, STEP)
    #: Lengths of what remains of each vector and query after each block.
    left_v = [np.sqrt((vectors[at:] ** 2).sum(axis=0)) for at in cuts]
    left_q = [np.sqrt((queries[:, at:] ** 2).sum(axis=1)) for at in cuts]
    floor = scores[:, -1] if bounds is None else np.maximum(scores[:, -1], bounds)
    for group in range(0, n, GROUP):
        rows = slice(group, min(group + GROUP, n))
        q, low = queries[rows], floor[rows]
        alive = np.arange(m)
        part = q[:, :STEP] @ vectors[:STEP]
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for block, at in enumerate(cuts):
            if pairs is None:
                most = part + (left_q[block][rows] * (1 + 1e-9))[:, None] * left_v[block][alive][None, :] + 1e-6
                keep = most >= low[:, None]
                needed = keep.any(axis=0)
                share = np.count_nonzero(keep)
                if share < LISTED * keep.size:
                    i, j = np.nonzero(keep)
                    part, pairs = part[i, j], (i, alive[j])
                elif np.count_nonzero(needed) < 0.8 * len(alive):
                    alive, part = alive[needed], np.ascontiguousarray(part[:, needed])
            else:
                i, j = pairs
                keep = part + left_q[block][rows][i] * (1 + 1e-9) * left_v[block][j] + 1e-6 >= low[i]
                share = np.count_nonzero(keep)
                part, pairs = part[keep], (i[keep], j[keep])
            if dropped is not None and at + STEP >= d:
                dropped[0] += len(q) * m - share
            if pairs is None:
                part += q[:, at : at + STEP] @ (vectors[at : at + STEP, alive] if len(alive) < m else vectors[at : at + STEP])
            else:
                i, j = pairs
                for x in range(at, min(at + STEP, d)):
                    part += q[i, x] * vectors[x, j]
        if dropped is not None:
            dropped[1] += len(q) * m
        if pairs is not None:
            starts = np.searchsorted(pairs[0], np.arange(len(q) + 1))
        for i in range(len(q)):
            s, at = (part[i], alive) if pairs is None else (part[starts[i] : starts[i + 1]], pairs[1][starts[i] : starts[i + 1]])
            names = ids[at]
            hit = np.flatnonzero((s >= low[i]) & (names != own[group + i]))
            if not len(hit):
                continue
            if len(hit) > 4 * k:
                cut = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                hit = hit[s[hit] >= cut]
            all_s = np.concatenate([scores[group + i], s[hit]])
            all_i = np.concatenate([found[group + i], names[hit]])
            top = np.lexsort((all_i, -all_s))[:k]
            scores[group + i], found[group + i] = all_s[top], all_i[top]
    return scores, found


def first_bounds(queries: np.ndarray, own: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th best score of each query among seeds (ids, vectors), -inf where there are fewer."""
    ids, vectors = seeds
    out = np.full(len(own), -np.inf)
    if len(ids) > k:
        for lo in range(0, len(own), 512):
            s = queries[lo : lo + 512] @ vectors.T
            s[own[lo : lo + 512][:, None] == ids[None, :]] = -np.inf
            out[lo : lo + 512] = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def _matrix(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch, by the vectors' length."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        at = starts[rows][:, None] + np.arange(d)[None, :]
        out[int(d)] = (ids[rows], flat[at] if d else np.zeros((len(rows), 0)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    vectors and queries: vec_id and v, an array of whole numbers, without nulls.
    """
    spark = vectors.sparkSession
    ship(spark)
    queries = queries.select("vec_id", "v").distinct()
    n = queries.count()
    n_blocks = max(1, -(-n // block))
    if n_blocks > 1:  # each block reads both again
        queries, vectors = table(queries, "queries"), table(vectors.select("vec_id", "v"), "vectors")
    every = vectors.count()
    seeds: dict[int, tuple[list, list]] = {}
    for r in vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SEEDS / max(every, 1)))).select("vec_id", "v").collect():  # about SEEDS rows
        of = seeds.setdefault(len(r.v), ([], []))
        of[0].append(r.vec_id)
        of[1].append(r.v)
    matrix = lambda ids, rows, d: (np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64).reshape(len(ids), d))
    seeded = {d: matrix(i, v, d) for d, (i, v) in seeds.items()}
    parts = []
    schema = "query_id long, vec_id long, score long"
    for b in range(n_blocks):
        mine = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        rows = mine.collect()  # about ``block`` rows, whatever the table's size
        if not rows:
            continue
        by: dict[int, tuple[list, list]] = {}
        for r in rows:
            own, at = by.setdefault(len(r.v), ([], []))
            own.append(r.vec_id)
            at.append(r.v)
        asked_for = {d: matrix(o, v, d) for d, (o, v) in by.items()}
        none = (np.zeros(0, dtype=np.int64), np.zeros((0, 0)))
        sent = spark.sparkContext.broadcast({d: (o, v, first_bounds(v, o, seeded.get(d, none), k)) for d, (o, v) in asked_for.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            best = {d: (np.full((len(o), k), -np.inf), np.full((len(o), k), np.iinfo(np.int64).max)) for d, (o, _, _) in asked.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                for d, (ids, v) in _matrix(batch).items():
                    if d in asked:
                        own, q, bounds = asked[d]
                        for at in range(0, len(ids), TILE):
                            best[d] = search_tile(q, own, np.ascontiguousarray(v[at : at + TILE].T), ids[at : at + TILE], k, best[d], bounds)
            for d, (own, _, _) in asked.items():
                s, i = best[d]
                row, col = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(i[row, col]), pa.array(s[row, col].astype(np.int64))], names=["query_id", "vec_id", "score"])

        part = vectors.select("vec_id", "v").mapInArrow(run, schema)
        parts.append(table(part, "topk") if n_blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v: each component x as floor(scale * x); only whole, finite vectors."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.select("vec_id", "embedding", x.alias("x")).filter(good).select(F.col("vec_id").cast("long"), F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
