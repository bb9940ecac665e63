"""Prediction by partial matching over bytes: counted on Spark, compiled to one table of code lengths.

A text is read as START START START bytes END. Contexts are the last 0 to 3 bytes; the tree holds those
admitted, and a byte is coded in the longest of its contexts that the tree holds. Escapes are estimated by
the number of different symbols a context has seen (method C), and symbols of a context are excluded
below it. Statistics are frozen, so the code length of each symbol in each context is one number.

Contexts that a tree has no room for can stay on Spark: their counts go where they are asked for, and give the
same code lengths as in a tree that holds them (``split_contexts``, ``RareContexts``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .shared import as_bytes

START, END = 0xFF, 0xFE  # no byte of UTF-8
ORDER = 3
_SYMBOLS = 255  # what can be coded: all bytes but START
_PIECE = 1 << 19  # bytes worked on at a time
_HEAD = bytes([START]) * ORDER


def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Framed texts joined to pieces: bytes, and the number of the text of each byte that is to be coded
    (the first ORDER bytes of a piece are context only). A long text goes over several pieces."""
    held, owner, size = [], [], 0

    def piece():
        data = np.frombuffer(b"".join(held), np.uint8)
        return data, np.repeat(np.array(owner), [len(h) for h in held])

    for i, t in enumerate(texts):
        framed = _HEAD + t + bytes([END])
        for at in range(ORDER, len(framed), _PIECE):
            held.append(framed[at - ORDER:at + _PIECE])
            owner.append(i)
            size += len(held[-1])
            if size >= _PIECE:
                yield piece()
                held, owner, size = [], [], 0
    if held:
        yield piece()


def _coded(owner: np.ndarray) -> np.ndarray:
    """Which bytes of a piece are coded: all but the first ORDER of each part."""
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    mask = np.ones(len(owner), bool)
    for k in range(ORDER):
        mask[begins + k] = False
    return mask


def _keys(data: np.ndarray) -> np.ndarray:
    """Each byte of a piece from the ORDER-th on, with its context before it, as one number."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def _grams(translate: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}

        def fold(label):
            k = np.concatenate([x for x, _ in total[label]])
            n = np.concatenate([x for _, x in total[label]])
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            total[label] = [(k[first], np.add.reduceat(n, first))]

        for b in batches:
            groups: dict[str, list[bytes]] = {}
            for label, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                groups.setdefault(label, []).append(t.translate(translate) if translate else t)
            for label, texts in groups.items():
                for data, owner in _windows(texts):
                    k, n = np.unique(_keys(data)[_coded(owner)[3:]], return_counts=True)
                    total.setdefault(label, []).append((k, n))
                    if len(total[label]) > 16:
                        fold(label)
        for label in total:
            fold(label)
            k, n = total[label][0]
            for at in range(0, len(k), 100_000):
                m = len(k[at:at + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * m, pa.string()), pa.array(k[at:at + m].astype(np.int64)), pa.array(n[at:at + m].astype(np.int64))], names=["label", "gram", "n"])

    return run


def _counted(texts: DataFrame, label: Column, content: Column, translate: bytes | None) -> DataFrame:
    """How often each symbol comes in each context: label, ord, key (context and symbol), ctx, n. Every text is
    counted whole, in its partition, and only sums are shuffled."""
    grams = texts.select(label.cast("string").alias("label"), content.alias("t")).mapInArrow(_grams(translate), "label string, gram long, n long")
    grams = grams.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    keys = F.array(*[F.struct(F.lit(k).alias("ord"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")) for k in range(ORDER + 1)])
    by = grams.select("label", "n", F.explode(keys).alias("x")).groupBy("label", "x.ord", "x.key").agg(F.sum("n").alias("n"))
    return by.withColumn("ctx", F.shiftright("key", 8))


def _collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
    out: dict[str, list] = {}
    for r in counts.select("label", "ord", "key", "n").toLocalIterator():
        out.setdefault(r["label"], []).append((r["ord"], r["key"], r["n"]))
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def count_contexts(texts: DataFrame, label: Column, content: Column, contexts: int, translate: bytes | None = None) -> dict[str, tuple[np.ndarray, ...]]:
    """Per label the counts (order, context with symbol, n) of its tree.

    Of orders 2 and 3 a tree admits the ``contexts`` most frequent contexts, ties to the smaller one; order 1 and 0
    are complete. So what reaches the driver is at most 255 * (2 * contexts + 256) numbers per label.
    """
    by = _counted(texts, label, content, translate)
    size = by.groupBy("label", "ord", "ctx").agg(F.sum("n").alias("all"))
    rank = F.row_number().over(Window.partitionBy("label", "ord").orderBy(F.desc("all"), "ctx"))
    kept = size.withColumn("r", rank).where((F.col("r") <= contexts) | (F.col("ord") < 2)).select("label", "ord", "ctx")
    return _collected(by.join(kept, ["label", "ord", "ctx"]))


def split_contexts(texts: DataFrame, content: Column, contexts: int, translate: bytes | None = None) -> tuple[tuple[np.ndarray, ...], DataFrame | None]:
    """Counts of one tree (order, context with symbol, n), and the counts of all contexts that it does not hold.

    Orders 0 to 2 are complete (two bytes have at most 65,536 values). Of order 3 the tree holds the
    ``contexts`` most frequent contexts, ties to the smaller one; the second result has the others (ctx, key, n),
    stays on Spark and is None if there are none.
    """
    by = cut_lineage(_counted(texts, F.lit(""), content, translate), "contexts")
    longest = by.where(F.col("ord") == ORDER)
    size = longest.groupBy("ctx").agg(F.sum("n").alias("all"))
    held = cut_lineage(size.orderBy(F.desc("all"), "ctx").limit(contexts).select("ctx"), "held")
    tree = by.where(F.col("ord") < ORDER).unionByName(longest.join(held, "ctx", "left_semi").select(by.columns))
    counts = _collected(tree).get("", (np.zeros(0, np.int64),) * 3)
    if held.count() < contexts:
        return counts, None
    return counts, longest.join(held, "ctx", "left_anti").select("ctx", "key", "n")


class ByteTree:
    """A compiled context tree: ``lengths(texts)`` gives the code length of each text in bits, END included."""

    def __init__(self, order: np.ndarray, key: np.ndarray, n: np.ndarray):
        seen = np.zeros(256, bool)
        for k in range(ORDER + 1):
            part = key[order == k]
            for j in range(k + 1):
                seen[(part >> (8 * j)) & 255] = True
        self.width = int(seen.sum()) + 1  # the last column is for each symbol never seen
        self.code = np.full(256, self.width - 1, np.int32)
        self.code[seen] = np.arange(self.width - 1)
        can = np.zeros(self.width, bool)
        can[self.code[[b for b in range(256) if seen[b] and b != START]]] = True
        rest = max(1, _SYMBOLS - int(can.sum()))
        w = self.width
        probs, counts, at, base = [], [], None, 0
        for k in range(ORDER + 1):
            mine = order == k
            symbol = self.code[key[mine] & 255]
            ctx = np.zeros(mine.sum(), np.int64)
            for j in range(k, 0, -1):
                ctx = ctx * w + self.code[(key[mine] >> (8 * j)) & 255]
            ids, place = np.unique(ctx, return_inverse=True)
            c = np.zeros((len(ids), w))
            np.add.at(c, (place, symbol), n[mine])
            if k == ORDER:
                # what contexts beside the tree need of their shorter end
                self.shorter, self.whole, self.escape = base - len(c_before), base, esc
                self.total, self.kinds = c_before.sum(1), (c_before > 0).sum(1)
            if k == 0:
                below, low, up = np.full((1, w), 1.0 / rest), np.zeros((1, w)), np.zeros(len(ids), np.int64)
                esc_below = np.ones(1)
            else:
                up = parent[ids % w ** (k - 1)]
                below, low, esc_below = p, c_before, esc
            rows = np.empty((len(ids), w), np.float32)
            new_esc = np.empty(len(ids))
            for s in range(0, len(ids), 4096):
                part, u = c[s:s + 4096], up[s:s + 4096]
                has = part > 0
                q, total = has.sum(1), part.sum(1)
                e = q / np.maximum(total + q, 1)
                left = np.where(has, 0, low[u])  # counts of the parent without what is excluded
                lq, lt = (left > 0).sum(1), left.sum(1)
                room = np.maximum(lt + lq, 1)
                skip = np.where(lq > 0, lq / room, 1.0)
                deeper = below[u] / esc_below[u][:, None] * skip[:, None]
                rows[s:s + 4096] = np.where(has, part / np.maximum(total + q, 1)[:, None], e[:, None] * np.where(left > 0, left / room[:, None], deeper))
                new_esc[s:s + 4096] = e
            # the state of each context of this length: its own, or that of its longest end
            states = np.tile(at, w) if at is not None and k else np.zeros(1, np.int32)
            states[ids] = base + np.arange(len(ids), dtype=np.int32)
            parent = np.full(w ** k, 0, np.int64)
            parent[ids] = np.arange(len(ids))
            probs.append(rows)
            at, base = states, base + len(ids)
            p, c_before, esc = rows.astype(np.float64) if k < ORDER else None, c, new_esc
        self.states = at
        table = np.concatenate(probs)
        with np.errstate(divide="ignore"):
            table = np.where(table > 0, -np.log2(table), 0).astype(np.float32)
        self.table = table.ravel()

        part = order == ORDER - 1
        by_key = np.argsort(key[part])
        self.short_keys, self.short_n = key[part][by_key], n[part][by_key]

    def _states(self, s: np.ndarray) -> np.ndarray:
        return self.states[(s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]]

    def missing(self, texts: list[bytes]) -> np.ndarray:
        """The contexts of ORDER bytes in the texts that the tree does not hold."""
        parts = [np.zeros(0, np.uint32)]
        for data, owner in _windows(texts):
            out = (self._states(self.code[data]) < self.whole) & _coded(owner)[3:]
            parts.append(np.unique(_keys(data)[out] >> 8))
        return np.unique(np.concatenate(parts))

    def lengths(self, texts: list[bytes], rare: RareContexts | None = None) -> np.ndarray:
        """``rare``: all learned contexts of the texts that the tree does not hold; without it these count as not learned."""
        out = np.zeros(len(texts))
        for data, owner in _windows(texts):
            s = self.code[data]
            state = self._states(s)
            bits = self.table[state.astype(np.int64) * self.width + s[3:]]
            if rare is not None:
                at = np.flatnonzero(state < self.whole)
                asked, back = np.unique(_keys(data)[at], return_inverse=True)
                known, got = rare.lengths(asked)
                at, back = at[known[back]], back[known[back]]
                bits[at] = got[back]
            bits[~_coded(owner)[3:]] = 0
            own = owner[3:]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[first]] += np.add.reduceat(bits, first, dtype=np.float64)
        return out


class RareContexts:
    """Contexts of ORDER bytes that a tree of complete shorter ones does not hold, made of the counts of their symbols."""

    def __init__(self, tree: ByteTree, key: np.ndarray, n: np.ndarray):
        self.tree = tree
        by_key = np.argsort(key)
        self.key, self.n = key[by_key], n[by_key]
        self.ctx, first, kinds = np.unique(self.key >> 8, return_index=True, return_counts=True)
        if not len(self.ctx):
            return
        self.total = np.add.reduceat(self.n, first) + kinds
        self.escape = kinds / self.total
        # the shorter context without the symbols of the longer one: their sum and number
        short = self._short(self.ctx << 8) - tree.shorter
        left = tree.kinds[short] - kinds
        self.room = np.maximum(tree.total[short] - np.add.reduceat(self._shorter_n(self.key), first) + left, 1)
        # what escapes both contexts, of what escapes the shorter one
        self.deeper = self.escape * np.where(left > 0, left / self.room, 1.0) / tree.escape[short]

    def _short(self, key: np.ndarray) -> np.ndarray:
        """State of the context without its first byte."""
        c, w = self.tree.code, self.tree.width
        return self.tree.states[(c[key >> 24] * w + c[(key >> 16) & 255]) * w + c[(key >> 8) & 255]]

    def _shorter_n(self, key: np.ndarray) -> np.ndarray:
        """Counts of the symbols in the context without its first byte."""
        return _at(self.tree.short_keys, self.tree.short_n, key & 0xFFFFFF)

    def lengths(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context with symbol whether it is one of these contexts, and if so the code length in bits."""
        key = key.astype(np.int64)
        i = _at(self.ctx, np.arange(1, len(self.ctx) + 1), key >> 8) - 1
        known, bits = i >= 0, np.zeros(len(key))
        key, i = key[known], i[known]
        if len(key):
            n, shorter_n = _at(self.key, self.n, key), self._shorter_n(key)
            state = self._short(key).astype(np.int64)
            low = self.tree.table[state * self.tree.width + self.tree.code[key & 255]].astype(np.float64)
            escaped = np.where(shorter_n > 0, self.escape[i] * shorter_n / self.room[i], self.deeper[i] * 2.0 ** -low)
            bits[known] = -np.log2(np.where(n > 0, n / self.total[i], escaped))
        return known, bits


def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of sorted keys where asked for, 0 for others."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[i] == asked, values[i], 0)
