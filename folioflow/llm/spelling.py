"""Spelling variants of words in dialogue lines: one letter too few, too many or other than in a frequent word."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .shared import LOWER, as_bytes

#: words of these letters; only A-Z are lower-cased
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: columns of the letter counts; letters are folded into them, which can only bring words nearer
COLUMNS = 128


def count_words(lines: DataFrame, key: str = "panel", text: str = "text", slip: int | None = None) -> DataFrame:
    """(word, n): how often each run of the letters A-Z, a-z, U+00C0 to U+00FF occurs in whole lines, A-Z as a-z.

    With ``slip``, slips of the pen are planted: where ``slip`` divides h, the unsigned crc32 of "<key>:<word>" in
    UTF-8, the word loses its letter number h % length (from 0). Words are counted per batch before they are
    shuffled. Null texts have no words, a null key counts as an empty text; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for k, t in zip(as_bytes(b.column(0)), as_bytes(b.column(1))):
                found = LETTERS.findall(t.translate(LOWER).decode("utf-8", "replace"))
                if not slip:
                    counts.update(found)
                    continue
                start = zlib.crc32(k + b":")
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    counts[word] += n
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        yield out()

    rows = lines.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: list[str], groups: int) -> list[list[int]]:
    out = []
    for w in words:
        c = [0] * groups
        for x in w:
            c[ord(x) % groups] += 1
        out.append(c)
    return out


def _counts(words: list[str], kind: type) -> np.ndarray:
    """Letter counts, one row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) % COLUMNS
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(rows * COLUMNS + codes, minlength=len(words) * COLUMNS).reshape(-1, COLUMNS).astype(kind)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_pairs(a: list[str], b: list[str], same: bool) -> list[tuple[int, int]]:
    """Places of words of two lists that are one edit apart; ``same``: each pair of one list once.

    The product of the letter counts gives all squared distances; one edit moves them by at most two.
    """
    kind = np.float32 if max(map(len, a + b), default=0) < 2000 else np.float64  # whole numbers stay exact
    x = _counts(a, kind)
    y = x if same else _counts(b, kind)
    far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    i, j = np.nonzero(far <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    return [(p, q) for p, q in zip(i.tolist(), j.tolist()) if one_edit(a[p], b[q])]


def spelling_variants(words: DataFrame, least: int = 5, letters: int = 6, ratio: int = 5, groups: int = 5, piece: int = 1024) -> DataFrame:
    """Which frequent word each word is a variant of. ``words`` (word, n) are counts, such as those of ``count_words``.

    Of the words of at least ``letters`` letters and ``least`` occurrences, two are near if they differ by
    exactly one inserted, deleted or replaced letter. The form of a word is the most frequent near word (ties:
    smallest in code-point order) if that is at least ``ratio`` times as frequent, else null. Returns ``word``, ``n``,
    ``n_near`` (near words), ``form``, ``form_n`` and ``root`` (the last word when forms are followed; the word itself
    if it has none).

    Words lie in cells by how many of their letters are of each of ``groups`` kinds, so one cell holds one length.
    A near word is in the same cell or in one of the cells of the same or an adjacent length that one edit
    leads to, so no pair is lost. A cell is cut by hash into pieces of about ``piece`` words, pieces of such cells
    meet by equality, and each meeting is one product of letter counts. A large cell is many tasks.

    Several rows of a word are added up, null words left out. An empty table gives no rows; other columns are not read.
    """
    counts = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    counts = cut_lineage(counts.where((F.col("n") >= least) & (F.length("word") >= letters)), "words")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = pa.array(_cells(b.column(0).to_pylist(), groups), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], names=["word", "n", "cell"])

    placed = counts.mapInArrow(place, "word string, n long, cell array<int>")
    placed = cut_lineage(placed, "cells")
    sizes = cut_lineage(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")), "sizes")
    pieces = placed.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    pieces = cut_lineage(pieces.groupBy("cell", "piece").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("ws")), "pieces")

    def moved(up: int, down: int | None):
        return F.array(*[F.col("cell")[g] + ((g == up) - (g == down)) for g in range(groups)])

    steps = [F.col("cell"), *[moved(g, None) for g in range(groups)], *[moved(h, g) for g in range(groups) for h in range(g + 1, groups)]]
    meets = pieces.select("cell", "piece", F.explode(F.array_distinct(F.array(*steps))).alias("other"))
    meets = meets.join(sizes.toDF("other", "pieces"), "other").withColumn("same", F.col("cell") == F.col("other"))
    first = F.when(F.col("same"), F.col("piece")).otherwise(0)
    meets = meets.select("cell", "piece", "other", F.explode(F.sequence(first, F.col("pieces") - 1)).alias("q"))
    meets = meets.join(pieces.withColumnRenamed("ws", "a"), ["cell", "piece"]).join(pieces.toDF("other", "q", "b"), ["other", "q"])
    meets = meets.select("a", "b", ((F.col("cell") == F.col("other")) & (F.col("piece") == F.col("q"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(c)[r].values.flatten() for c in (0, 1))
                (wa, na), (wb, nb) = ((w.to_pylist(), n.to_numpy()) for w, n in (a, b))
                got = near_pairs(wa, wb, batch.column(2)[r].as_py())
                i, j = [p for p, _ in got], [q for _, q in got]
                word = [wa[p] for p in i] + [wb[q] for q in j]
                near = [wb[q] for q in j] + [wa[p] for p in i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(np.concatenate([nb[j], na[i]]) if i else [], pa.int64())], names=["word", "near", "near_n"])

    near = meets.mapInArrow(run, "word string, near string, near_n long")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = counts.join(best, "word", "left")
    strong = -F.col("best.n") >= ratio * F.col("n")
    found = cut_lineage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.n")).alias("form_n")), "forms")
    return found.join(_last(found.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _last(steps: DataFrame) -> DataFrame:
    """(word, root): where forms end. A form is more frequent than its word, so there is no ring; each round doubles the steps."""
    now = cut_lineage(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = now.join(far, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
        nxt = cut_lineage(nxt, "roots")
        now = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return now
