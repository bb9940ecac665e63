"""Near-duplicate scripts by one-permutation MinHash with banded buckets and star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .shared import LOWER, as_bytes, components

_LOW = np.uint64((1 << 52) - 1)


def shingle_set(text: bytes, words: int) -> tuple[list[bytes], set[bytes]]:
    """The words of a text and its set of word shingles; a shorter text is one shingle."""
    w = text.translate(LOWER).split()
    if not w:
        return w, set()
    if len(w) < words:
        return w, {b" ".join(w)}
    return w, set(map(b" ".join, zip(*[w[i:] for i in range(words)])))


def probe_order(bins: int, seed: int) -> np.ndarray:
    """For each bin the order in which an empty one asks the others for a value."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def signature(shingles: set[bytes], probes: np.ndarray, seed: int) -> np.ndarray:
    """One hash per shingle; the least of each bin; empty bins take that of the first filled bin they
    ask, each in an order of its own (optimal densification)."""
    bins = len(probes)
    h = np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    x = np.sort((at << np.uint64(52)) | (xxh_mix(h) & _LOW))
    own = (x >> np.uint64(52)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[own[first]], filled[own[first]] = x[first] & _LOW, True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = probes[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def xxh_mix(h: np.ndarray) -> np.ndarray:
    """A second value of a hash, so that the place in a bin says nothing about the bin."""
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _signed(words: int, bands: int, rows: int, seed: int):
    probes = probe_order(bands * rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, keys = [], [], []
            for text in as_bytes(b.column(1)):
                w, s = shingle_set(text, words)
                n.append(len(s))
                digest.append(hashlib.md5(b" ".join(w)).digest() if s else None)
                if s:
                    sig = signature(s, probes, seed)
                    keys.append([xxhash.xxh3_64_intdigest(sig[i * rows:(i + 1) * rows].tobytes(), i) - (1 << 63) for i in range(bands)])
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "told", "n_shingles", "digest", "bands"])

    return run


def _shingles(words: int):
    """A row per shingle of a text, told by a 64-bit hash, with the number of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                h = np.fromiter({xxhash.xxh3_64_intdigest(s) for s in shingle_set(text, words)[1]}, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(h), pa.binary()), pa.array(np.full(len(h), len(h))), pa.array(h)], names=["node", "n", "h"])

    return run


def _confirmed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            keep = []
            for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3))):
                if x != last:
                    last, left = x, shingle_set(x, words)[1]
                right = shingle_set(y, words)[1]
                same = len(left & right)
                keep.append(same > 0 and 100 * same >= percent * (len(left) + len(right) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicate_scripts(
    scripts: DataFrame, key: str = "panel", content: str = "content", words: int = 5, similarity: float = 0.8,
    bands: int = 32, rows: int = 5, seed: int = 1,
) -> DataFrame:
    """Groups of panel scripts whose word shingles have a Jaccard similarity of at least ``similarity``.

    Returns one row per script: ``key``, ``n_shingles`` (size of its set), ``component_id`` (smallest
    key reachable over links, itself included) and ``kept`` (the script is that smallest one).

    * Scripts of equal words are one class, told by a digest of 128 bits, and need no comparison.
    * ``bands * rows`` bins of one permutation give ``bands`` bucket keys per class. A pair at 0.8
      shares a bucket with a probability of 1 - (1 - 0.8^5)^32 = 0.999997.
    * The members of a bucket are paired with two pivots, those of the least and the greatest digest, so pairs
      grow with the number of members only. Each pair is confirmed on the full shingle sets.
    * Members of buckets in which these links leave several groups meet once more, exactly: each class stands in
      an index under the rarest of its shingles, as many as two sets of that similarity cannot all miss (n - 0.8 n + 1),
      rarity counted over these classes. A shingle of one class takes a place but meets nobody. Pairs of different
      groups under one shingle are confirmed if their sizes and its places in both orders allow the similarity.

    A null or blank text has no shingles and links with nothing; a text shorter than ``words`` is one
    shingle. Rows of one key are one script for linking, with the links of all its texts, and stay as many rows. A
    null key links with nothing, has no component and is kept. Other columns of ``scripts`` are not read.
    """
    percent = round(100 * similarity)
    docs = scripts.select(F.col(key).alias("id"), F.col(content).alias("text"), F.xxhash64(F.col(content)).alias("told"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = cut_lineage(docs.mapInArrow(
        _signed(words, bands, rows, seed), f"id {kind}, told long, n_shingles long, digest binary, bands array<long>"), "signed")
    known = signed.where("digest is not null and id is not null")
    first = F.min_by(F.struct("told", "bands", "n_shingles"), F.struct("id", "told")).alias("_f")
    classes = cut_lineage(known.groupBy("digest").agg(F.min("id").alias("rep"), first).select(
        F.col("digest").alias("node"), "rep", "_f.told", "_f.bands", F.col("_f.n_shingles").alias("n")), "classes")

    spread = classes.select("node", F.explode("bands").alias("bucket"))
    pivots = spread.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = cut_lineage(spread.join(pivots, "bucket"), "members")
    where = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("id"), "told")
    texts = docs.join(where, ["id", "told"]).select("node", "text")
    texts = cut_lineage(texts, "texts").dropDuplicates(["node"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
        return cut_lineage(both.mapInArrow(_confirmed(words, percent), "a binary, b binary"), "confirmed")

    sizes = classes.select("node", "n")
    star = members.select("node", F.explode(F.array("low", "high")).alias("o")).where("node <> o")
    star = star.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()
    star = star.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    star = star.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    # the texts of one key are one script
    texts_of = known.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    same_key = known.join(texts_of.select("id", "a"), "id").select("a", F.col("digest").alias("b")).where("a <> b").distinct()
    links = confirmed(cut_lineage(star, "pairs")).unionByName(same_key)
    groups = components(links)

    # what the pivots left apart: buckets of several groups
    named = groups.withColumnRenamed("component", "c")
    labelled = members.select("bucket", "node").join(named, "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket")
    apart = cut_lineage(labelled.join(mixed, "bucket").select("node", "c").distinct(), "apart")
    shingles = texts.join(apart.select("node"), "node", "left_semi").mapInArrow(_shingles(words), "node binary, n long, h long")
    shingles = cut_lineage(shingles, "shingles")
    held = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rare = shingles.join(held, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "h"))).alias("hs"))
    places = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("hs"))
    index = rare.where(places > 0).select("node", "n", (F.col("n") - F.size("hs")).alias("own"), F.posexplode(F.slice("hs", F.lit(1), places.cast("int"))).alias("at", "_h"))
    # shingles from this one on, in the order of rarity: the first that two sets share leaves no more to share than these
    index = index.select("node", "n", "_h.h", (F.col("n") - F.col("own") - F.col("at")).alias("ahead"))
    index = cut_lineage(index.join(apart, "node"), "index")
    other = index.select("h", F.col("node").alias("o"), F.col("c").alias("oc"), F.col("n").alias("on"), F.col("ahead").alias("oahead"))
    fits = (100 + percent) * F.least("ahead", "oahead") >= percent * (F.col("n") + F.col("on"))
    rest = index.join(other, "h").where((F.col("node") < F.col("o")) & (F.col("c") != F.col("oc")) & fits)
    rest = cut_lineage(rest.select(F.col("node").alias("a"), F.col("o").alias("b")).distinct(), "pairs")
    groups = components(links.unionByName(confirmed(rest)))

    found = groups.join(classes.select("node", "rep"), "node")
    least = found.groupBy("component").agg(F.min("rep").alias("root"))
    root = classes.select("node", "rep").join(groups.join(least, "component").select("node", "root"), "node", "left").select(
        F.col("node").alias("digest"), F.coalesce("root", "rep").alias("root"))
    told = known.select("id", "n_shingles", "digest").join(root, "digest").select("id", "n_shingles", "root")
    alone = signed.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("root"))
    return told.unionByName(alone).select(
        F.col("id").alias(key), "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))
