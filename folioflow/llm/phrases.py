"""Phrase collocations of panel scripts, per section: frequent phrases by mergeable Misra-Gries summaries, then exact counts."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .shared import as_bytes

#: a phrase never reaches over these
DELIMITERS = b".,;:!?\n\x0b\x0c\r"
#: marks a delimiter or a text's end; no UTF-8 text holds this byte
BREAK = b"\xff"
_TABLE = bytes(255 if i in DELIMITERS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Numbers(dict):
    """Number of each word, in order of appearance, and the words' hashes; 0 is a break."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.words, self.hashes = [BREAK], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


@dataclass
class _Stretch:
    """Some texts as word numbers, with the group of each place."""

    at: np.ndarray
    group: np.ndarray
    words: list[bytes]
    hashes: np.ndarray
    groups: list[str]

    def grams(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hashes) of the phrases of 1 to ``size`` words."""
        word = self.hashes[self.at]
        seed = np.array([xxhash.xxh64_intdigest(g, 1) for g in self.groups], np.uint64)
        inside = self.at > 0
        h, ok = _mix(word ^ seed[self.group]), inside
        for n in range(1, size + 1):
            if n > 1:
                h, ok = _mix(h[:-1] * _MIX + word[n - 1:]), ok[:-1] & inside[n - 1:]
            places = np.nonzero(ok)[0]
            yield n, places, h[places]


def _stretches(batches: Iterator[pa.RecordBatch], tokens: int = 500_000) -> Iterator[_Stretch]:
    numbers, names = _Numbers(), {}
    at, size, group = [], [], []
    total = 0

    def out() -> _Stretch:
        return _Stretch(np.concatenate(at), np.repeat(np.array(group, np.int32), size), numbers.words, np.array(numbers.hashes, np.uint64), list(names))

    for batch in batches:
        for b in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):  # some texts at a time
            for g, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                words = t.translate(_TABLE).replace(BREAK, b" \xff ").split()
                words.append(BREAK)
                at.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size.append(len(words))
                group.append(names.setdefault(g, len(names)))
                total += len(words)
                if total >= tokens:
                    yield out()
                    at, size, group, total = [], [], [], 0
                    if len(numbers) > tokens:
                        numbers, names = _Numbers(), {}
    if at:
        yield out()


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Summary:
    """Misra-Gries summary of at most ``capacity`` counters.

    A key's count is at most its counter (none: 0) plus ``error``, and ``error`` times capacity + 1 is at most the mass
    that was added. Summaries merge by adding counters and errors, then taking the first counter too many off all.
    """

    def __init__(self, capacity: int):
        self.capacity, self.error, self.mass = capacity, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        self.waiting.append((keys, counts))
        self.mass += int(counts.sum())
        self.error += error
        if sum(len(k) for k, _ in self.waiting) > 1 << 20:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting = []
        self.keys, self.counts = added(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off
            self.error += off

    def possible(self, threshold: int) -> np.ndarray:
        """Keys whose count may reach the threshold; all that do, if ``error`` is below it."""
        self.settle()
        return self.keys[self.counts + self.error >= threshold]


def _frequent(texts: DataFrame, size: int, threshold: int, parts: int | None, capacity: int | None) -> DataFrame:
    """(h): hashes of all phrases that occur at least ``threshold`` times in their group, and of few others."""
    spark = texts.sparkSession
    # a word and its blank take two bytes or more, and a word begins at most one phrase of each size
    bound = int(texts.agg(F.sum(F.floor((F.octet_length("t") + 1) / 2))).first()[0] or 0) * size
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bound // (threshold * (2 << 20)))
    parts = 1 << max(1, math.ceil(math.log2(max(parts, 2))))
    capacity = capacity or bound // parts // threshold + 1
    shift = np.uint64(64 - int(math.log2(parts)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches):
            hashes = np.concatenate([h for _, _, h in s.grams(size)])
            keys, counts = added(hashes, np.ones(len(hashes), np.int64))
            cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
            got = [(p, keys[i:j], counts[i:j]) for p, i, j in zip(range(parts), cuts[:-1], cuts[1:]) if j > i]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _, _ in got], pa.int32()), pa.array([k.tobytes() for _, k, _ in got], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, _, c in got], pa.binary())], names=["part", "keys", "counts"])

    def merged(room: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, s = None, None

            def out() -> pa.RecordBatch:
                keys = s.possible(threshold).view(np.int64)
                return pa.RecordBatch.from_arrays([
                    pa.array([now], pa.int32()), pa.array([s.mass], pa.int64()), pa.array([s.error], pa.int64()), pa.array([keys], pa.list_(pa.int64()))],
                    names=["part", "mass", "error", "keys"])

            for b in batches:
                for i in range(b.num_rows):
                    p, k, c = b.column(0)[i].as_py(), b.column(1)[i].as_buffer(), b.column(2)[i].as_buffer()
                    if p != now:
                        if s is not None:
                            yield out()
                        now, s = p, Summary(room.get(p, capacity))
                    s.merge(np.frombuffer(k, np.uint64), np.frombuffer(c, "<u4").astype(np.int64))
            if s is not None:
                yield out()
        return run

    rows = texts.mapInArrow(local, "part int, keys binary, counts binary")
    kept, room = None, {}
    while True:
        todo = rows if kept is None else rows.where(F.col("part").isin(list(room)))
        got = todo.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merged(room), "part int, mass long, error long, keys array<long>")
        got = cut_lineage(got, "summaries")
        good = got.where(F.col("error") < threshold).select(F.explode("keys").alias("h"))
        kept = good if kept is None else kept.unionByName(good)
        # a part whose mass is above the bound of an even deal takes the capacity that its own mass asks for
        room = {r["part"]: r["mass"] // threshold + 1 for r in got.where(F.col("error") >= threshold).select("part", "mass").collect()}
        if not room:
            return kept


def _filter_bits(hashes: DataFrame, most: int = 1 << 22) -> np.ndarray:
    """Bloom filter of the hashes, four bits of one 64-bit word each; at most ``most`` words (32 MB).

    Where there are more hashes than it can tell apart, more phrases pass and are counted for nothing; none is lost.
    """
    hashes = cut_lineage(hashes, "frequent")
    words = 1 << min(int(math.log2(most)), max(6, math.ceil(math.log2(hashes.count() / 4 + 1))))
    one = F.lit(1).cast("bigint")
    bits = None
    for i in range(4):
        b = F.call_function("shiftleft", one, F.shiftrightunsigned("h", 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        bits = b if bits is None else bits.bitwiseOR(b)
    rows = hashes.groupBy(F.col("h").bitwiseAND(F.lit(words - 1)).cast("int").alias("w")).agg(F.bit_or(bits).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    want = np.zeros(len(h), np.uint64)
    for i in range(4):
        want |= np.uint64(1) << (h >> np.uint64(40 + 6 * i) & np.uint64(63))
    return bits[h & np.uint64(len(bits) - 1)] & want == want


def _phrases(s: _Stretch, n: int, places: np.ndarray, h: np.ndarray) -> tuple[list[str], list[bytes], np.ndarray]:
    """Groups, phrases and counts of the phrases of ``n`` words at some places."""
    cols = [s.group[places].astype(np.int64), *(s.at[places + i] for i in range(n))]
    order = np.argsort(h, kind="stable")
    cols = [c[order] for c in cols]
    h = h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    differ = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    if (differ & ~new).any():  # two phrases of one hash
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        differ = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    first = np.nonzero(differ)[0]
    group, *word = [c[first].tolist() for c in cols]
    counts = np.diff(np.append(first, len(h)))
    w = s.words
    return [s.groups[g] for g in group], [b" ".join([w[i] for i in t]) for t in zip(*word)], counts


def collocations(
    sections: DataFrame, group: str = "heading", body: str = "body", least: int = 10, size: int = 3, within: int = 50, top: int = 2000,
    parts: int | None = None, capacity: int | None = None,
) -> DataFrame:
    """The strongest phrases of two to ``size`` words in the bodies of sections, per heading.

    A-Z count as a-z. Bodies fall into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs.
    ``n`` counts the words of a group, f(phrase) its occurrences within pieces, overlaps included. Phrases with
    a = f(phrase) >= ``least`` are candidates. Cut behind its first k words, a candidate has l = f(first part),
    r = f(rest) and the score floor(1000000 * a * a / (l * r)), exactly; its lowest cut counts, ties to the smallest k.
    Candidates inside a longer one with 100 * f(longer) >= ``within`` * a go. Returns per group the ``top`` best by score
    and a descending, then phrase: ``group``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    First pass: each task counts hashed phrases of a stretch of text and deals them by hash; each hash partition merges
    them into a Misra-Gries summary with more counters than its mass has thresholds, so that no frequent phrase
    is lost; ``parts`` and ``capacity`` default to what the size of all texts asks for, and a partition whose error
    reaches the threshold is merged again with the capacity of its own mass. Second pass: phrases that pass a filter
    of bounded size, made from the summaries, are counted exactly.

    A null group is ``und``, a null text has no words. Rows count as often as they come; an empty table gives no
    rows; other columns are not read.
    """
    if size not in (2, 3):
        raise ValueError("phrases have at most two or three words")
    spark = sections.sparkSession
    texts = sections.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("g"), F.col(body).alias("t"))
    bits = spark.sparkContext.broadcast(_filter_bits(_frequent(texts, size, least, parts, capacity)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "phrase", "w", "n"]
        for s in _stretches(batches):
            for n, places, h in s.grams(size):
                if n == 1:  # all words of each group, as a row without a phrase
                    per = np.bincount(s.group[places], minlength=len(s.groups))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(s.groups, pa.string()), pa.nulls(len(per), pa.string()), pa.array([0] * len(per), pa.int32()), pa.array(per, pa.int64())], names=names)
                hit = _passes(bits.value, h)
                if hit.any():
                    g, p, c = _phrases(s, n, places[hit], h[hit])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(g, pa.string()), pa.array(p, pa.binary()).cast(pa.string()), pa.array([n] * len(p), pa.int32()), pa.array(c, pa.int64())], names=names)

    counts = texts.mapInArrow(exact, "g string, phrase string, w int, n long").groupBy("g", "phrase", "w").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")
    totals = counts.where("phrase is null").select(F.col("g").alias("_g"), F.col("n").alias("total"))
    counts = counts.where("phrase is not null")

    x = F.split("phrase", " ")
    cut = lambda i, j: F.concat_ws(" ", F.slice(x, i, j))
    side = lambda k, left, text, w: F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), text.alias("part"), F.lit(w).alias("pw"))
    two = F.array(side(1, True, cut(1, 1), 1), side(1, False, cut(2, 1), 1))
    three = F.array(side(1, True, cut(1, 1), 1), side(1, False, cut(2, 2), 2), side(2, True, cut(1, 2), 2), side(2, False, cut(3, 1), 1))
    sides = counts.where("w > 1").select("g", "phrase", "w", F.col("n").alias("a"), F.explode(F.when(F.col("w") == 2, two).otherwise(three)).alias("s")).select("*", "s.*")
    known = counts.select("g", F.col("phrase").alias("part"), F.col("n").alias("f"))

    def f(k: int, left: bool):
        return F.max(F.when((F.col("k") == k) & (F.col("left") == F.lit(left)), F.col("f")))

    scored = sides.join(known, ["g", "part"]).groupBy("g", "phrase", "w", "a").agg(f(1, True).alias("l1"), f(1, False).alias("r1"), f(2, True).alias("l2"), f(2, False).alias("r2"))
    whole = "cast({} as decimal(14,0))"
    score = "(cast(1000000 as decimal(7,0)) * {a} * {a}) div ({l} * {r})"
    for k in "12":
        scored = scored.withColumn(f"s{k}", F.expr(score.format(a=whole.format("a"), l=whole.format(f"l{k}"), r=whole.format(f"r{k}"))))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    longer = sides.where("w = 3 and pw = 2").groupBy("g", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["g", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))
    left = left.select("g", "phrase", "a", *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))])
    # the best of each task go on, so a group is never in one task as a whole
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, best["g"] == totals["_g"]).select(
        F.col("g").alias(group), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint").alias("score"))
