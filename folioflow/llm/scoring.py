"""Language-model scores of panel scripts: a PPM byte model, and a unigram base over all words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ppm import ByteTree, RareContexts, split_contexts
from .shared import LOWER, as_bytes

#: stands for the end of a text among the words, which never hold a blank
STOP = b" "


def _words(missing: Callable[[list[bytes]], np.ndarray] | None) -> Callable[[pa.Table], pa.Table]:
    """Words of the texts of a block, and how often those to learn from have each; then, one row each, the contexts that ``missing`` finds."""
    def run(block: pa.Table) -> pa.Table:
        learned, seen, texts = Counter(), set(), []
        for text, learn in zip(as_bytes(block.column("t")), block.column("learn").to_pylist()):
            texts.append(text.translate(LOWER))
            w = texts[-1].split()
            w.append(STOP)
            if learn:
                learned.update(w)
            else:
                seen.update(w)
        for w in seen:
            learned.setdefault(w, 0)
        asked = missing(texts) if missing else np.zeros(0, np.int64)
        i, k, m = block.column("block")[0].as_py() if block.num_rows else 0, len(learned), len(asked)
        return pa.table(
            [pa.array([i] * (k + m), pa.int64()), pa.concat_arrays([pa.array(learned.keys(), pa.binary()), pa.nulls(m, pa.binary())]),
             pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(asked.astype(np.int64))]), pa.concat_arrays([pa.array(learned.values(), pa.int64()), pa.array(np.zeros(m, np.int64))])],
            names=["block", "word", "ctx", "n"])

    return run


def score_scripts(
    scripts: DataFrame, learn: Column, key: str = "panel", content: str = "content", contexts: int = 60_000, block_rows: int = 4000,
) -> DataFrame:
    """Scores of whole scripts under models learned from all scripts where ``learn`` is true.

    A-Z count as a-z. Returns ``key``, ``n_tokens`` (words and one end), ``n_known`` (tokens that the learned
    texts have), ``train_tokens``, ``base_score`` (sum of log10((c + 1) / (N + V + 1)) over the tokens) and
    ``score``, log10 of the probability that the byte model gives the text and its end.

    The byte model is a PPM tree of order 3 with escapes and symbol exclusion, counted over all learned
    texts. Its ``contexts`` most frequent contexts of three bytes and all shorter ones are held in memory; the others stay
    on Spark and go to the blocks that ask for them, so scores do not depend on ``contexts``. Word counts
    are of any size and stay on Spark too: texts are dealt into blocks of about ``block_rows`` by hash, a word has one
    row per block, counts are added per word and go back to the blocks, where each text is scored.

    A null text is an empty one: one token, the end. Null keys and repeated rows give a row each. With
    nothing to learn from, N and V are 0 and the byte model is uniform. Other columns are not read.
    """
    spark = scripts.sparkSession
    rows = scripts.select(F.col(key).alias("id"), F.col(content).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts, rest = split_contexts(rows.where("learn"), F.col("t"), contexts, LOWER)
    tree = spark.sparkContext.broadcast(ByteTree(*counts))

    blocks = max(1, math.ceil(rows.count() / block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    split = rest is not None
    missing = (lambda texts: tree.value.missing(texts)) if split else None
    words = dealt.groupBy("block").applyInArrow(_words(missing), "block long, word binary, ctx long, n long")
    every = Window.partitionBy("word", "ctx")
    first = F.row_number().over(every.orderBy("block")) == 1
    known = cut_lineage(words.select("*", F.sum("n").over(every).alias("c"), first.alias("first")), "words")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    n_train, floor = total["n"], math.log10(total["n"] + total["v"] + 1)
    needed = known.where("word is not null").select("block", "word", "c")
    if split:
        asked = known.where("word is null").select("block", "word", "ctx").join(rest, "ctx")
        needed = needed.withColumn("key", F.lit(None).cast("bigint")).unionByName(asked.select("block", "word", F.col("n").alias("c"), "key"))

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        rare = None
        if split:
            word = pc.is_valid(table.column("word"))
            beside, table = table.filter(pc.invert(word)), table.filter(word)
            rare = RareContexts(tree.value, beside.column("key").to_numpy(), beside.column("c").to_numpy())
        counts = np.array(table.column("c").to_pylist(), np.int64)
        logs = dict(zip(table.column("word").to_pylist(), zip(np.log10(counts + 1.0).tolist(), (counts > 0).tolist())))
        out: list[list] = [[], [], [], []]
        step = 500
        for at in range(0, texts.num_rows, step):
            part = [t.translate(LOWER) for t in as_bytes(texts.column("t").slice(at, step).combine_chunks())]
            for t in part:
                w = t.split()
                w.append(STOP)
                got = [logs[x] for x in w]
                out[0].append(len(w))
                out[1].append(sum(k for _, k in got))
                out[2].append(math.fsum(x for x, _ in got) - len(w) * floor)
            out[3].extend((-tree.value.lengths(part, rare) * math.log10(2)).tolist())
        n = texts.num_rows
        return pa.table(
            [texts.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([n_train] * n, pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return dealt.select("block", "id", "t").groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        score, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).select(F.col("id").alias(key), "n_tokens", "n_known", "train_tokens", "base_score", "score")
