"""Language of panel scripts by prediction by partial matching: one byte context tree per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ppm import ByteTree, count_contexts
from .shared import as_bytes

UNKNOWN = "und"
_STEP = 1000  # rows of a batch worked on at a time


def train_languages(
    scripts: DataFrame, learn: Column, key: str = "panel", content: str = "content", lang: str = "lang", rows: int = 3000, contexts: int = 20_000,
) -> dict[str, ByteTree]:
    """A context tree per language.

    Of the rows where ``learn`` holds and text and language are not null, each language gives at most
    ``rows`` whole texts, those with the smallest hashes of their keys. ``contexts`` bounds each tree.
    """
    known = scripts.where(learn & F.col(content).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("l"), F.col(content).alias("t"), F.xxhash64(F.col(key)).alias("h"))
    # the hash that ends the sample is found first, so that no texts are moved to find it
    edge = known.select("l", "h").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= rows).groupBy("l").agg(F.max("h").alias("to"))
    sample = known.join(cut_lineage(edge, "edges"), "l").where("h <= to")
    return {k: ByteTree(*v) for k, v in sorted(count_contexts(sample, F.col("l"), F.col("t"), contexts).items())}


def script_language(scripts: DataFrame, models: dict[str, ByteTree], key: str = "panel", content: str = "content", carry: list[str] | None = None) -> DataFrame:
    """Language of each whole script: the tree that codes it shortest; ties go to the smaller name.

    Returns ``key``, the columns of ``carry``, ``lang_pred`` and ``score``, the share of that language if each is weighed by two to
    the minus code length (0 to 1). A text that is null or without a letter, or any text when no
    language was learned, is ``und`` with score 0. Repeated rows and null keys give a row each; other
    columns of ``scripts`` are not read. A carried column of a result's name gives way to the result.
    """
    names = list(models)
    trees = scripts.sparkSession.sparkContext.broadcast([models[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, _STEP) for b in batches for at in range(0, b.num_rows, _STEP)):
            texts, spoken = as_bytes(b.column(1)), np.array(b.column(2).to_pylist(), bool)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if names and len(texts):
                bits = np.stack([t.lengths(texts) for t in trees.value])
                best = bits.argmin(0)
                share = 1 / np.exp2(np.maximum(bits.min(0) - bits, -1000)).sum(0)
                lang = np.where(spoken, np.array(names, object)[best], UNKNOWN)
                score = np.where(spoken, share, 0.0)
            said = [b.column(1)] if content in wanted else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), *said, *b.columns[3:]], names=["id", "lang_pred", "score", *["t"] * len(said), *b.schema.names[3:]])

    t = F.col(content)
    wanted = [c for c in carry or [] if c not in (key, "lang_pred", "score")]
    more = [c for c in wanted if c != content]  # the text itself goes to Python once
    rows = scripts.select(
        F.col(key).alias("id"), t.alias("t"), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("spoken"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(more)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(["id " + kinds["id"], "lang_pred string", "score double", *["t string"] * (content in wanted), *[f"_{i} {kinds[f'_{i}']}" for i in range(len(more))]])
    return rows.mapInArrow(run, out).select(F.col("id").alias(key), *[F.col("t" if c == content else f"_{more.index(c)}").alias(c) for c in wanted], "lang_pred", "score")
