"""Near-duplicate vectors by NN-descent: a neighbour graph refined by joins over neighbours of neighbours.

The project keeps no vectors; the operator is general and takes any table of keys and vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .multiindex import matrix, usable
from .shared import components

_LINK = "u long, v long, s double"


def _links(u, v, s) -> pa.Table:
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "s"])


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar columns of each row of a square matrix, itself left out."""
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], s[:0, 0]
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(s, near, 1).ravel()


def _leaves(leaf: int, k: int):
    """Neighbours within runs of at most ``leaf`` rows of one code; also each row's leaf, named by its first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list]] = []

        def out():
            ids = np.array([h[1] for h in held], np.int64)
            m = np.array([h[2] for h in held])
            u, v, s = _best(ids, m @ m.T, k)
            at = ids.min()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[u, ids]), pa.array(np.r_[v, np.full(len(ids), at)]), pa.array(np.r_[s, np.full(len(ids), np.nan)])], names=["u", "v", "s"])

        for b in batches:
            for code, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), matrix(b.column(2))):
                if held and (held[-1][0] != code or len(held) == leaf):
                    yield out()
                    held = []
                held.append((code, i, v))
        if held:
            yield out()

    return run


def _across(leaf: int, near: float):
    """Links between groups within runs of at most ``leaf`` rows of one code: the best one of each two groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []

        def out():
            ids, c = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64)
            m = np.array([h[3] for h in held])
            s = m @ m.T
            i, j = np.nonzero((s >= near) & (c[:, None] < c))
            order = np.lexsort((-s[i, j], c[j], c[i]))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.r_[True, (c[i][1:] != c[i][:-1]) | (c[j][1:] != c[j][:-1])][:len(i)])
            i, j = i[first], j[first]
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["u", "v", "s"])

        for b in batches:
            for code, i, v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), matrix(b.column(2)), b.column(3).to_pylist()):
                if held and (held[-1][0] != code or len(held) == leaf):
                    yield out()
                    held = []
                held.append((code, i, c, v))
        if held:
            yield out()

    return run


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = np.array(b.column(2).to_pylist(), bool)
        digests, units = [], []
        for good, v in zip(ok, b.column(1).to_pylist()):
            if good:
                v = np.array(v, np.float64)
                digests.append(hashlib.md5(v.tobytes()).digest())
                v = v / np.abs(v).max()
                units.append(v / np.sqrt(v @ v))
            else:
                digests.append(None), units.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["id", "digest", "v"])


def _top(links: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return links.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def near_duplicate_vectors(
    vectors: DataFrame, key: str = "panel", vector: str = "embedding", similarity: float = 0.9, k: int = 10, trees: int = 6, leaf: int = 256,
    rounds: int = 6, audit: int = 200, recall: float = 0.999, piece: int = 1024, seed: int = 3,
) -> DataFrame:
    """Links between vectors of cosine at least ``similarity`` (double precision), and their groups.

    * Equal vectors are one node with a multiplicity. The graph starts with neighbours inside the
      leaves of ``trees`` random hyperplane codes, ``k`` per node.
    * A round of NN-descent compares the neighbours (and reverse neighbours) of each node with each other.
      The work is dealt by leaves of the first tree, whose nodes share most neighbours. Rounds end when fewer
      than one in a thousand list entries change.
    * A list is saturated if its last neighbour still reaches the threshold, and then shows its own group only. So
      fresh trees look for links between different groups alone, and join them, until ``trees`` of them show none.
    * Inside each group all pairs are compared in tiles of ``piece`` rows, which yields the exact number of links
      of each node without writing pairs.
    * An audit compares ``audit`` hashed nodes with all others; while the share of their links inside groups, over all
      links or as the mean of the nodes, is below ``recall``, further trees and rounds follow (at most ``rounds``
      times, then it is an error).

    Returns one row per row of ``vectors``: ``key``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest key reachable, itself included), ``kept`` (the key is that smallest one). Vectors that are
    null, zero or hold null or non-finite components link with nothing. A null key has no component, no
    links, and is kept. Rows of one key and vector count as several vectors for others. Vectors of the most frequent
    length are compared, others link with nothing. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.where(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 0
    fit = F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == d)
    known = cut_lineage(rows.select("id", "v", F.coalesce(fit, F.lit(False)).alias("ok")).mapInArrow(_prepared, "id long, digest binary, v array<double>"), "vectors")
    nodes = known.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    nodes = cut_lineage(nodes, "nodes")
    n = nodes.count()
    parts = max(spark.sparkContext.defaultParallelism, n // 5000)
    bits = max(1, int(np.log2(max(2, n / (leaf / 2)))))
    near = F.lit(similarity - 1e-9)

    def tree(t: int, groups: DataFrame | None = None) -> DataFrame:
        """Neighbours in the leaves of a tree; with groups, links between different ones, the leaves cut in another order."""
        planes = np.random.default_rng([seed, t]).standard_normal((bits, d))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bit = (matrix(b.column(1)) @ planes.T > 0).astype(np.int64) if b.num_rows else np.zeros((0, bits), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit @ (1 << np.arange(bits))), b.column(0), b.column(1)], names=["code", "id", "v"])

        coded = nodes.select("id", "v").mapInArrow(code, "code long, id long, v array<double>")
        if groups is not None:
            coded = coded.join(groups, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).withColumn("h", F.xxhash64(F.lit(t), "id"))
            dealt = coded.repartitionByRange(parts, "code", "h").sortWithinPartitions("code", "h")
            return dealt.select("code", "id", "v", "c").mapInArrow(_across(leaf, similarity - 1e-9), _LINK)
        # a code that very many vectors share is cut by key
        return coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").mapInArrow(_leaves(leaf, k), _LINK)

    def descend(need: pa.Table, lists: pa.Table) -> pa.Table:
        m, ids = matrix(need.column("v")), need.column("id").to_numpy()
        order = np.argsort(ids)
        m, ids = m[order], ids[order]
        u, v = lists.column("u").to_numpy(), lists.column("v").to_numpy()
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        v = np.searchsorted(ids, v)
        a, b, s = [], [], []
        for group in np.split(v, np.flatnonzero(u[1:] != u[:-1]) + 1):
            if len(group) > 1:
                x, y, z = _best(group, m[group] @ m[group].T, k)
                a.append(x), b.append(y), s.append(z)
        if not a:
            return _links([], [], [])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        pair, first = np.unique(a * len(ids) + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < k
        return _links(ids[a[keep]], ids[b[keep]], s[keep])

    def counted(part: pa.Table) -> pa.Table:
        m, ids, mult = matrix(part.column("v")), part.column("id").to_numpy(), part.column("m").to_numpy()
        tile, left = np.array(part.column("tile").to_pylist()), np.array(part.column("left").to_pylist(), bool)
        order = np.argsort(tile, kind="stable")
        out_id, out_n = [], []
        for own in np.split(order, np.flatnonzero(tile[order][1:] != tile[order][:-1]) + 1):
            a, b = own[left[own]], own[~left[own]]
            if len(a) and len(b):
                hit = (m[a] @ m[b].T >= similarity - 1e-15) & (ids[a][:, None] != ids[b])
                out_id.append(ids[a]), out_n.append(hit @ mult[b])
        return pa.table([pa.array(np.concatenate(out_id) if out_id else [], pa.int64()), pa.array(np.concatenate(out_n) if out_n else [], pa.int64())], names=["id", "n"])

    def audited(groups: DataFrame) -> float:
        asked = nodes.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h").limit(audit).toPandas()
        if not len(asked):
            return 1.0
        q, ids = np.array(asked["v"].tolist()), asked["id"].to_numpy()

        def all_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    i, j = np.nonzero(q @ matrix(b.column(1)).T >= similarity)
                    mine = b.column(0).to_numpy()
                    yield from _links(ids[i], mine[j], np.ones(len(i))).to_batches()

        true = nodes.select("id", "v").mapInArrow(all_links, _LINK).where("u <> v")
        g = groups.select("node", "component")
        both = true.join(g.toDF("u", "cu"), "u", "left").join(g.toDF("v", "cv"), "v", "left")
        each = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cu") == F.col("cv")).alias("hit"))
        r = each.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.avg(F.col("hit") / F.col("n")).alias("mean")).first()
        return min(r["hit"] / r["n"], r["mean"]) if r["n"] else 1.0

    graph, leaf_of, fresh = None, None, rounds * trees
    for attempt in range(rounds if n else 0):
        grown = [tree(attempt * trees + t) for t in range(trees)]
        first = cut_lineage(grown[0], "tree")
        if leaf_of is None:
            leaf_of = first.where("isnan(s)").select("u", F.col("v").alias("leaf"))
        start = first
        for g in grown[1:]:
            start = start.unionByName(g)
        start = start.where("not isnan(s)")
        graph = cut_lineage(_top(start if graph is None else start.unionByName(graph), k), "graph")
        for _ in range(rounds):
            back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
            both = graph.unionByName(_top(back, k)).select("u", "v").distinct()
            lists = both.join(leaf_of, "u")
            lists = cut_lineage(lists.unionByName(lists.select("u", F.col("u").alias("v"), "leaf")).distinct(), "lists")
            need = lists.select(F.col("leaf").alias("at"), F.col("v").alias("id")).distinct().join(nodes.select("id", "v"), "id")
            new = need.groupBy("at").cogroup(lists.groupBy("leaf")).applyInArrow(descend, _LINK)
            better = cut_lineage(_top(graph.unionByName(new), k), "graph")
            changed = better.join(graph, ["u", "v"], "left_anti").count()
            graph = better
            if changed <= n * k / 1000:
                break
        edges = graph.where(F.col("s") >= near).select(F.col("u").alias("a"), F.col("v").alias("b"))
        groups = cut_lineage(components(edges), "groups")
        while True:  # full lists hide other groups: fresh trees, in which only other groups count, until none is met
            fresh += trees
            met = tree(fresh, groups)
            for t in range(1, trees):
                met = met.unionByName(tree(fresh + t, groups))
            met = cut_lineage(met.select(F.col("u").alias("a"), F.col("v").alias("b")), "across")
            if met.isEmpty():
                break
            groups = cut_lineage(components(met.unionByName(groups.toDF("a", "b"))), "groups")
        share = audited(groups)
        if share >= recall:
            break
    else:
        if n:
            raise RuntimeError(f"{share:.4f} of the audited links are inside groups, {recall} are asked for")

    out = known.select("id", "digest").join(nodes.select("digest", F.col("id").alias("rep"), "m"), "digest", "left")
    if n:
        inside = nodes.join(groups, nodes["id"] == groups["node"]).select("id", "m", "v", "component")
        sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        inside = inside.join(sizes, "component").withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = inside.select("id", "m", "v", F.concat_ws(":", "component", "p", "q").alias("tile"), F.lit(True).alias("left")).unionByName(
            inside.select("id", "m", "v", F.concat_ws(":", "component", "q", "p").alias("tile"), F.lit(False).alias("left")))
        links = tiles.withColumn("g", F.when(F.col("tile").endswith(":0:0"), F.concat(F.lit("g"), F.pmod(F.xxhash64("tile"), F.lit(parts)))).otherwise(F.col("tile"))).groupBy("g").applyInArrow(
            counted, "id long, n long").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
        out = out.join(links.join(groups, "node"), F.col("rep") == F.col("node"), "left")
    else:
        out = out.withColumns({"n": F.lit(0), "component": F.lit(None).cast("long")})
    root = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(key), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))).cast("bigint").alias("n_links"), root.alias("component_id"),
        F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))
