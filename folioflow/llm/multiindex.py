"""Nearest neighbours by an inverted multi-index: two quantised halves, cells by summed distance, exact rerank.

The project keeps no vectors; the operator is general and takes any table of keys and vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def k_means(x: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """Centroids of a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> dict[int, list[int]]:
    """Cells in the order of summed distance until they hold ``wanted`` vectors: right halves by left half.

    ``left`` and ``right`` are the distances of the two halves to their centroids, ``counts`` the vectors per cell.
    """
    a, b = left.argsort(kind="stable"), right.argsort(kind="stable")
    heap, found, out = [(left[a[0]] + right[b[0]], 0, 0)], 0, {}
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            out.setdefault(int(a[i]), []).append(int(b[j]))
            found += n
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each cell enters the heap once
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "panel", vector: str = "embedding", k: int = 20, centroids: int = 64,
    share: float = 0.5, sample: int = 20_000, piece: int = 4096, seed: int = 5,
) -> DataFrame:
    """The ``k`` vectors with the largest inner product for each query, out of the cells it visits.

    ``vectors`` and ``queries`` have ``key`` (an integer) and ``vector``; a query does not find its own key. Each
    half of a vector is assigned to one of ``centroids`` centroids, fitted on the ``sample`` vectors with the smallest
    hashed keys; every vector is indexed. A query visits cells by the sum of the distances (minus inner product) of its
    halves until they hold the ``share`` of all vectors, which are reranked by the inner product in double
    precision. The default share keeps recall over 0.9 on vectors without structure; clustered ones need far less.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, ties to the smaller key. The vectors of
    a left half are dealt into pieces of about ``piece``, and what leaves a piece are the best ``k`` per
    query, so neither a full cell nor equal vectors meet in one task.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null keys and
    vectors of another length than the most frequent one (ties: the longer). Repeated keys are as many candidates. Other columns are not read.
    """
    def rows(df):
        return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    base, asked = rows(vectors), rows(queries)
    out = "query_id long, rank int, vec_id long, score double"
    usual = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], out)
    d = usual["d"]
    base, asked, h = base.where(F.size("v") == d), asked.where(F.size("v") == d), max(1, d // 2)
    x = np.array(base.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).toPandas()["v"].tolist(), np.float64)
    c1 = k_means(x[:, :h], centroids, seed)
    c2 = k_means(x[:, h:], centroids, seed + 1) if d > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            if len(m):
                ids = [(p @ c.T - (c * c).sum(1) / 2).argmax(1) for p, c in ((m[:, :h], c1), (m[:, h:], c2))]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(i.astype(np.int32)) for i in ids]], names=["id", "v", "c1", "c2"])

    index = cut_lineage(base.mapInArrow(assign, "id long, v array<double>, c1 int, c2 int"), "index")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # one row per cell at most
        counts[r["c1"], r["c2"]] = r["count"]
    pieces, candidates = np.maximum(1, -(-counts.sum(1) // piece)), max(k + 1, int(np.ceil(share * counts.sum())))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q, c, cells, p = [], [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), matrix(b.column(1))):
                for one, two in traverse(-(c1 @ v[:h]), -(c2 @ v[h:]), counts, candidates).items():
                    for part in range(int(pieces[one])):
                        ids.append(i), q.append(v), c.append(one), cells.append(two), p.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(q, pa.list_(pa.float64())), pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                names=["id", "v", "c1", "piece", "cells"])

    visits = asked.mapInArrow(visit, "id long, v array<double>, c1 int, piece int, cells array<int>")
    of = F.get(F.array(*[F.lit(int(p)) for p in pieces]), F.col("c1"))
    dealt = index.withColumn("piece", F.pmod(F.xxhash64("id"), of).cast("int"))

    def rerank(vs: pa.Table, qs: pa.Table) -> pa.Table:
        got: list[tuple[int, int, float]] = []
        m = matrix(vs.column("v"))
        ids, cell = vs.column("id").to_numpy(), vs.column("c2").to_numpy()
        for at in range(0, qs.num_rows if vs.num_rows else 0, 256):
            part = qs.slice(at, 256)
            q, asks = matrix(part.column("v")), part.column("id").to_numpy()
            visited = np.zeros((len(q), len(c2)), bool)
            for i, cells in enumerate(part.column("cells").to_pylist()):
                visited[i, cells] = True
            s = q @ m.T
            s[~visited[:, cell] | (ids == asks[:, None])] = -np.inf
            edge = np.partition(s, -k, axis=1)[:, -k] if len(m) > k else np.full(len(q), -np.inf)
            slack = np.where(np.isfinite(edge), 1e-9 * (1 + np.abs(edge)), 0)  # the product's rounding depends on the place
            for i in range(len(q)):
                near = np.flatnonzero((s[i] >= edge[i] - slack[i]) & np.isfinite(s[i]))
                exact = (m[near] * q[i]).sum(1)
                for j in np.lexsort((ids[near], -exact))[:k]:
                    got.append((int(asks[i]), int(ids[near[j]]), float(exact[j])))
        cols = list(zip(*got)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    best = dealt.groupBy("c1", "piece").cogroup(visits.groupBy("c1", "piece")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
