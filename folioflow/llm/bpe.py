"""BPE encoding of prompts by an automaton compiled from the merges, and decoding by its arc labels."""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# fixed values: how the vocabulary file cuts a text into words, and its mark of a word's end
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton over tokens that accepts exactly the tokenizations BPE makes.

    It starts with one loop per base symbol. Each merge, in rank order, puts in a gadget: a new arc for the
    merged token, entered where its left part was entered and left where its right part was left, and the
    path left part, right part is taken out. A state is the last token read; what all gadgets leave of
    the arcs between two states is decided by the ``spine`` of the tokens (parts and the merges that ended
    them), and each arc is put into the transition table when it is first asked for.
    Since the arcs are deterministic, each prefix of a word has one state, and encoding walks over the word once.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], room: int = 600_000):
        letters = {c: bytes([b]).decode("latin-1") for b, c in enumerate(byte_letters())}
        self.labels = {i: t for t, i in vocab.items()}
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            ends = token.endswith(END) and len(token) > len(END)
            body = token[: -len(END)] if ends else token
            if all(c in letters for c in body):
                (self.final if ends else self.inner)["".join(letters[c] for c in body)] = i
        self.starts = {t[:i] for t in [*self.inner, *self.final] for i in range(len(t) + 1)}
        self.steps: dict[tuple[str, str], str] = {}
        self.ending: dict[tuple[str, bool], tuple[tuple[int, int], ...]] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):  # one gadget per merge
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.rank[u, v] = r
            self.parts.setdefault(w, (u, v, r))
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, int, str]] = {}
        self.room = room

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token along one side, innermost first, each with the rank of the merge that ended it."""
        known = self.spines.get((token, side))
        if known is None:
            out, end, t = [(token, float("inf"))], None, token
            while t in self.parts:
                left, right, end = self.parts[t]
                t = right if side else left
                out.append((t, end))
            known = self.spines[token, side] = out[::-1]
        return known

    def arc(self, a: int, b: int) -> bool:
        """Is token b allowed after token a: no merge joins their parts while both still stand."""
        known = self.arcs.get((a, b))
        if known is None:
            xs, ys, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while True:
                (x, x_end), (y, y_end) = xs[i], ys[j]
                r = self.rank.get((x, y))
                if r is not None and r < x_end and r <= y_end:
                    known = False
                    break
                if i + 1 == len(xs) and j + 1 == len(ys):
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            self.arcs[a, b] = known
        return known

    def step(self, seen: str, letter: str) -> str:
        """The longest end of what was read that begins a token."""
        s = seen + letter
        while s not in self.starts:
            s = s[1:]
        self.steps[seen, letter] = s
        return s

    def ends(self, seen: str, last: bool) -> tuple[tuple[int, int], ...]:
        """Tokens (id, length) that end here, longest first; ``last``: those that end a word."""
        tokens = self.final if last else self.inner
        out = tuple((tokens[seen[i:]], len(seen) - i) for i in range(len(seen)) if seen[i:] in tokens)
        self.ending[seen, last] = out
        return out

    def word(self, word: str) -> list[int]:
        """Token ids of one word."""
        w = word.encode("utf-8").decode("latin-1")
        n, steps, ending, arcs = len(w), self.steps, self.ending, self.arcs
        state, size, seen = [-1] * (n + 1), [0] * (n + 1), ""
        for i, letter in enumerate(w, 1):
            at = seen, letter
            seen = steps[at] if at in steps else self.step(seen, letter)
            for t, k in ending.get((seen, i == n)) or self.ends(seen, i == n):
                if k == i:
                    state[i], size[i] = t, k
                    break
                before = state[i - k]
                ok = arcs.get((before, t))
                if ok or ok is None and before >= 0 and self.arc(before, t):
                    state[i], size[i] = t, k
                    break
        out, i = [], n
        while i > 0:
            out.append(state[i])
            i -= size[i]
        return out[::-1]

    def coded(self, word: str) -> tuple[bytes, int, str]:
        """Ids of a word as bytes, their number, and their labels; kept for words that come again."""
        hit = self.words.get(word)
        if hit is None:
            ids = self.word(word)
            hit = struct.pack(f"<{len(ids)}I", *ids), len(ids), self.decode(ids)
            if len(self.words) >= self.room:
                self.words.clear()
            self.words[word] = hit
        return hit

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, in order, with a blank between them (the vocabulary names no other decoder)."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


class TextCoder:
    """Whole texts: special tokens, normal form, words, and the automaton on each word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """Ids as little-endian 32-bit integers, their number, and the decoded text."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        ids, n, said = [], 0, []
        coded, known = self.automaton.coded, self.automaton.words
        for part in parts:
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                said.append(part)
                n += 1
                continue
            # capital sigma first: the vocabulary lowers each letter by itself
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in self.split.findall(plain):
                hit = known.get(word) or coded(word)
                ids.append(hit[0])
                n += hit[1]
                said.append(hit[2])
        return b"".join(ids), n, " ".join(said)


def encode_prompts(prompts: DataFrame, vocabulary: str, key: str = "panel", positive: str = "positive") -> DataFrame:
    """Token ids of whole prompts and the text decoded from them.

    ``vocabulary`` is the path of a word-level BPE file of the tokenizers library; the driver reads it and
    the compiled automaton, whose size the file bounds, goes to the executors. Returns ``key``,
    ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded``.

    Ids equal those of the library with ``add_special_tokens=False``; special tokens inside a text keep
    their ids. Null and blank texts give no ids and an empty text. Rows are independent, so repeated rows and
    null keys are no special case; other columns of ``prompts`` are not read.
    """
    coder = prompts.sparkSession.sparkContext.broadcast(TextCoder(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder.value.encode
        for b in batches:
            step = 256  # ids and texts of a part of a batch at a time
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                got = [encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"])

    rows = prompts.select(F.col(key).alias("id"), F.col(positive).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string").select(
        F.col("id").alias(key), "n_tokens", "ids", "decoded")
