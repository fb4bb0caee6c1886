"""Exact top-k search over an impact-ordered index, a score at a time.

Components are integers. The index of a block of vectors holds posting segments: for each level of
the quantised magnitude of a component and each dimension, the vectors that have such a component
there, with the component. A search takes segments from the highest impact down; each adds its
components, times the queries' weights in its dimension, to the accumulators of the vectors that it lists, so a
posting is worked on once at the most. What a vector has not contributed yet is the rest of its components, and by the
Cauchy-Schwarz inequality that rest can move the score by no more than |query| * |rest|; the norms of the
rests are kept with the index. After each level, vectors that no query can want any more leave the block, and a query
stops when at most ``rescore`` vectors can still reach its k-th best lower bound, and not before;
these are then scored exactly, as are all that tie.

Bounds are shared between blocks. The vectors of the largest norms, which can have the highest scores, are
one block and are searched first; the k-th best score that each query finds there is a proven bound, with which every
other block starts: vectors too short to reach it are never accumulated, and a query without any left stops at once.

Vectors and queries are dealt to blocks by hash, every query block meets every vector block, and the
best of the blocks are merged. Block counts follow from the row counts; nothing is broadcast.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, as
candidate or query, nor does a row without an id; missing components of a shorter vector are 0; a component of 2**53 or
more after quantisation, and a score that is no 64-bit integer, raise an error; rows that repeat an id are candidates
and queries each, but no query finds a row with its own id; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_table

VECTORS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
LEVELS = 8
RESCORE = 96
"""A query stops when at most so many vectors of a block can be among its best."""


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector takes no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    wide = F.transform(vector, lambda x: x.cast("double"))
    whole = lambda x: F.when(F.abs(x) * scale < float(1 << 53), F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component is too large to be exact")).cast("bigint"))
    return F.when(vector.isNotNull() & F.forall(wide, finite), F.transform(wide, whole))


class ImpactIndex:
    """The index of one block: segments by level, highest impact first, and the norms of the rests."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        size = np.abs(self.vectors).astype(np.float64)
        edges = np.unique(np.quantile(size[size > 0], np.linspace(0, 1, levels + 1)[:-1])) if (size > 0).any() else np.zeros(0)
        level = np.searchsorted(edges, size, side="right")  # 0: a component of 0, no posting
        self.top = len(edges)
        #: the norm of what a vector has below each level; the last is its whole norm
        self.rest = np.sqrt(np.stack([np.where(level < k, size**2, 0).sum(1) for k in range(1, self.top + 2)])) if len(self.ids) else np.zeros((self.top + 1, 0))
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for k in range(self.top, 0, -1):
            dims, rows = np.nonzero((level == k).T)
            cuts = np.flatnonzero(np.diff(dims)) + 1
            self.segments.append([(int(dims[r[0]]), rows[r], self.vectors[rows[r], dims[r[0]]].astype(np.float64)) for r in np.split(np.arange(len(dims)), cuts) if len(r)])
        #: postings, and those that the last search worked on, by query
        self.postings, self.visited = int((level > 0).sum()), 0

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None, rescore: int = RESCORE) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row, score) of the vectors that can be among the k best, and those that tie, for each query, scored exactly.

        ``own``: ids that the queries do not find; ``bound``: scores below which nothing is wanted.
        """
        n, count = len(own), len(self.ids)
        found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.visited = 0
        if not count or not n:
            return found
        weights = queries.astype(np.float64)
        norms = np.linalg.norm(weights, axis=1) * (1 + 1e-12)
        bound = np.full(n, -np.inf) if bound is None else bound.astype(np.float64)
        rows, live = np.arange(count), np.arange(n)
        score = np.zeros((count, n))
        first, last = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        for q in np.flatnonzero(first < last):
            score[first[q] : last[q], q] = -np.inf
        for at in range(self.top + 1):
            # what is left below the levels that were taken
            rows, live, score = self._settle(found, rows, live, score, queries, norms, bound, self.rest[self.top - at], k, rescore, exact=at == self.top)
            if not len(live) or at == self.top:
                break
            place = np.full(count, -1)
            place[rows] = np.arange(len(rows))
            for dim, listed, components in self.segments[at]:
                to = place[listed]
                if len(rows) < count:
                    components, to = components[to >= 0], to[to >= 0]
                if len(to):
                    score[to] += components[:, None] * weights[live, dim][None, :]
                    self.visited += len(to) * len(live)
        return found

    def _settle(self, found: list, rows: np.ndarray, live: np.ndarray, score: np.ndarray, queries: np.ndarray, norms: np.ndarray, bound: np.ndarray, rest: np.ndarray, k: int, rescore: int, exact: bool) -> tuple:
        """Finish the queries whose possible members are few; the others stay, with the vectors that any of them may want."""
        slack = rest[rows][:, None] * norms[live][None, :] * (1 + 1e-9) + 1e-6 + np.abs(np.where(np.isfinite(score), score, 0)) * 1e-12
        low = score - slack
        kth = np.partition(low, len(rows) - k, axis=0)[len(rows) - k] if len(rows) >= k else np.full(len(live), -np.inf)
        bound[live] = np.maximum(bound[live], kth)
        possible = (score + slack >= bound[live][None, :]) & np.isfinite(score)
        few = exact | (possible.sum(0) <= rescore)
        for at in np.flatnonzero(few):
            members = rows[possible[:, at]]
            found[live[at]] = (members, self._exact(members, queries[live[at]]))
        wanted = possible[:, ~few].any(1)
        return rows[wanted], live[~few], score[np.ix_(wanted, ~few)]

    def _exact(self, members: np.ndarray, query: np.ndarray) -> np.ndarray:
        vectors, query = self.vectors[members], query.astype(np.int64)
        most = np.abs(vectors).max(initial=0).astype(float) * float(np.abs(query).max(initial=0)) * max(1, vectors.shape[1])
        if most < 2.0**62:
            return vectors @ query
        scores = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors]
        if any(not -(2**63) <= s < 2**63 for s in scores):
            raise OverflowError("a score is no 64-bit integer")
        return np.array(scores, np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


_FOUND = "q bigint, query_id bigint, vec_id bigint, score bigint"


def _search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q", "query_id", "vec_id", "score")})
    width = max(vectors["v"].map(len).max(), queries["v"].map(len).max(), 1)
    dense = lambda column: np.stack([np.pad(np.asarray(x, np.int64), (0, width - len(x))) for x in column])
    index = ImpactIndex(vectors["id"].to_numpy(np.int64), dense(vectors["v"]))
    own, row = queries["id"].to_numpy(np.int64), queries["row"].to_numpy(np.int64)
    bound = queries["bound"].to_numpy(np.float64, na_value=-np.inf) if "bound" in queries else None
    parts = []
    for q, query, (rows, scores) in zip(row, own, index.search(own, dense(queries["v"]), k, bound), strict=True):
        best = _best(index.ids[rows], scores, k)
        parts.append((np.full(len(best), q), np.full(len(best), query), index.ids[rows][best], scores[best].astype(np.int64)))
    return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("q", "query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The k best vectors of each query by integer inner product; both have (id long, q array<long>).

    A query does not find vectors that have its id. Result: query_id, rank (from 1), vec_id, score.
    """
    taking = lambda df: df.filter(F.col("q").isNotNull() & F.col("id").isNotNull()).select("id", F.col("q").alias("v"))
    vectors = shared_table(taking(vectors.select(F.col("id").cast("bigint").alias("id"), "q")).withColumns({"norm": F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), "row": F.monotonically_increasing_id()}), "search-vectors")
    queries = shared_table(taking(queries.select(F.col("id").cast("bigint").alias("id"), "q")).withColumn("row", F.monotonically_increasing_id()), "search-queries")
    n_vectors, n_queries = vectors.count(), queries.count()
    rest_blocks, query_blocks = max(1, -(-max(0, n_vectors - vectors_per_block) // vectors_per_block)), max(1, -(-n_queries // queries_per_block))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(lambda x, y: _search_block(x, y, k), _FOUND)

    # the vectors of the largest norms: one block, cut at the norm and row of its last
    edge = vectors.select(F.struct("norm", "row").alias("at")).orderBy(F.desc("at")).limit(vectors_per_block).agg(F.min("at")).first()[0]
    cut = F.struct("norm", "row") >= F.struct(F.lit(edge["norm"] if edge else 0.0), F.lit(edge["row"] if edge else 0).cast("bigint"))
    of_queries = queries.withColumn("c", block(query_blocks))
    head = shared_table(met(vectors.filter(cut).select("id", "v", F.lit(0).alias("b"), every(query_blocks).alias("c")), of_queries.withColumn("b", F.lit(0))), "search-head")
    bounds = head.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") == k).select(F.col("q").alias("row"), F.col("score").alias("bound"))
    rest = met(
        vectors.filter(~cut).select("id", "v", block(rest_blocks).alias("b"), every(query_blocks).alias("c")),
        of_queries.join(bounds, "row", "left").withColumn("b", every(rest_blocks)),
    )
    ranked = head.union(rest).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
