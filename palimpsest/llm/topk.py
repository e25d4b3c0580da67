"""Exact top-k by inner product: columnar branch-and-bound over blocks of vectors.

Queries and candidates are packed into blocks of bounded size, and every pair of blocks is one task's work. A block is
held vertically, dimension block by dimension block. For each query the scores are accumulated one dimension block at a
time; what a candidate can still gain is bounded by the product of the remaining parts' lengths, and candidates whose
bound stays under the query's k-th best score so far are compacted away. Bounds only ever drop candidates that cannot
enter the result, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
DIM_BLOCK = 16
#: The first candidates are scored whole, for a first bound.
SEED_CANDIDATES = 512
#: Query blocks that meet a candidate block under one key of the join.
CELL = 16
#: Below this share of survivors they are scored one by one, above it block by block.
SPARSE = 0.1


def _wide(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search_blocks for components whose products might not fit a long, by integers of any size. Only a result that
    does not fit is an error."""
    rows = []
    held = [[int(x) for x in v] for v in c.tolist()]
    for i, v in zip(q_id.tolist(), q.tolist(), strict=True):
        own = [int(x) for x in v]
        scores = sorted((-sum(map(mul, own, w)), j) for j, w in zip(c_id.tolist(), held, strict=True) if j != i)[:k]
        rows += [(i, j, -s) for s, j in scores]
    if any(abs(s) >= 2**63 for *_, s in rows):
        raise ValueError("a score among the best does not fit a long")
    return tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 3


def search_blocks(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of each query's k best candidates other than itself, exact."""
    nq, nc, dims = len(q), len(c), q.shape[1]
    if object in (q.dtype, c.dtype):
        return _wide(q_id, q, c_id, c, k)
    longest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dims, 1)
    if longest >= 2**63:
        return _wide(q_id, q, c_id, c, k)
    exact = np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64
    order = np.argsort(-np.abs(c).sum(axis=0), kind="stable")
    cuts = [order[at : at + DIM_BLOCK] for at in range(0, dims, DIM_BLOCK)]
    qb, cb = [np.ascontiguousarray(q[:, d], dtype=exact) for d in cuts], [np.ascontiguousarray(c[:, d], dtype=exact) for d in cuts]
    # Slightly more than the true remaining lengths, so that rounding never drops a candidate.
    tail = lambda blocks: [np.sqrt(sum((b.astype(np.float64) ** 2).sum(axis=1) for b in blocks[at:])) * (1 + 1e-9) if at < len(blocks) else 0 for at in range(1, len(blocks) + 1)]
    q_rest, c_rest = tail(qb), tail(cb)
    own = q_id[:, None] == c_id[None, :SEED_CANDIDATES]
    seen = sum(a @ b[:SEED_CANDIDATES].T for a, b in zip(qb, cb, strict=True)) if cuts else np.zeros((nq, min(nc, SEED_CANDIDATES)))
    seen = np.where(own, -np.inf, seen.astype(np.float64))
    floor = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.full(nq, -np.inf)
    sums = np.zeros((nq, nc), dtype=exact)
    qi = ci = part = None
    for at, (a, b) in enumerate(zip(qb, cb, strict=True)):
        if qi is None:
            sums += a @ b.T
            bound = sums + q_rest[at] [:, None] * c_rest[at][None, :] if at + 1 < len(cuts) else sums
            live = bound >= floor[:, None]
            if live.mean() < SPARSE or at + 1 == len(cuts):
                qi, ci = np.nonzero(live)
                part = sums[qi, ci]
        else:
            part = part + np.einsum("ij,ij->i", a[qi], b[ci])
            bound = part + q_rest[at][qi] * c_rest[at][ci] if at + 1 < len(cuts) else part
            keep = bound >= floor[qi]
            qi, ci, part = qi[keep], ci[keep], part[keep]
    if qi is None:
        qi, ci = (x.ravel() for x in np.indices((nq, nc)))
        part = np.zeros(nq * nc)
    other = q_id[qi] != c_id[ci]
    qi, ci, part = qi[other], ci[other], part[other]
    best = np.lexsort((c_id[ci], -part.astype(np.float64) if exact != np.int64 else -part, qi))
    qi, ci, part = qi[best], ci[best], part[best]
    nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
    first = nth < k
    return q_id[qi[first]], c_id[ci[first]], part[first].astype(np.int64)


def _matrix(rows: list, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components, short vectors padded with zeros; integers of any size where some are wide."""
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) * scale < 2**62:
        return np.floor(out * scale).astype(np.int64)
    return np.array([[floor(Fraction(x) * scale) for x in v] for v in out.tolist()], dtype=object).reshape(len(rows), dims)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding",
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, id, score) for the queries, the rows whose id is divisible by ``every``, against all other rows.

    Components x count as floor(scale * x), exactly at any size; a score among the best beyond a long is an error. Rows
    with a null id, a null vector, or null or non-finite components take no part; shorter vectors count as padded with
    zeros; ties go to the smaller id; a repeated id is one candidate for each of its rows, and a query row never meets
    rows of its own id. An empty table gives an empty result; other columns are not looked at.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
    whole = cut(whole.withColumn("row", F.monotonically_increasing_id()))
    is_query = F.pmod("id", F.lit(every)) == 0
    sizes = whole.agg(F.count("*"), F.sum(is_query.cast("int")), F.max(F.size("v"))).first()
    n, n_query, dims = sizes[0], sizes[1] or 0, sizes[2] or 0
    q_blocks, c_blocks = max(1, -(-n_query // query_block)), max(1, -(-n // candidate_block))
    spread = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    pack = lambda df, m, salt: df.groupBy(spread(m, salt).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    # A block holds query_block or candidate_block rows on average by construction, whatever the ids or vectors are.
    queries = pack(whole.where(is_query), q_blocks, 1).select(F.col("block").alias("qb"), F.col("rows").alias("q"))
    candidates = pack(whole, c_blocks, 2).select(F.col("block").alias("cb"), F.col("rows").alias("c"))
    grid_q = queries.select((F.col("qb") % -(-q_blocks // CELL)).alias("salt"), "q", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    # Every candidate block is dealt to several keys, so that no key gathers more than CELL query blocks.
    dealt = candidates.select("cb", "c", F.explode(F.sequence(F.lit(0), F.lit(-(-q_blocks // CELL) - 1))).alias("salt"))
    # Blocks repeat on either side, so their true sizes are far over Spark's estimates, by which it would send all of a side
    # through the driver: never broadcast.
    pairs = grid_q.join(dealt.hint("merge"), ["cb", "salt"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, c in zip(batch["q"], batch["c"], strict=True):
                ids = [np.array([r["id"] for r in rows], dtype=np.int64) for rows in (q, c)]
                vectors = [_matrix([r["v"] for r in rows], dims, scale) for rows in (q, c)]
                found = search_blocks(ids[0], vectors[0], ids[1], vectors[1], k)
                yield pd.DataFrame(dict(zip(("query_id", "id", "score"), found, strict=True)))

    found = pairs.select("q", "c").mapInPandas(work, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
