"""Token records, spelling variants and phrase collocations against plain versions."""

import json
import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioflow.llm import phrases, records, spelling
from folioflow.llm.queries import BYTE_VOCABULARY, QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))


def plain_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (records.POLYNOMIAL if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert records.crc32c(b"123456789") == 0xE3069283
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 63, 1023, 1024, 1025, 2048, 3000):
        data = r.randbytes(n)
        assert records.crc32c(data) == plain_crc(data)


def test_coder_equals_the_library(library):
    coder = records.ByteCoder(library.to_str(), room=500)
    r = random.Random(2)
    parts = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "\r\n", "1", "42", "²", "½", "_", "'s", ".", "<|endoftext|>", " ", "日", "x́", "\x1c", "\x00", "€", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    want = [array("H", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.encode(t) for t in texts] == want


def test_prompt_records(spark, library, tmp_path):
    texts = ["girl, red coat", None, "", "long " * 30_000, "girl, red coat", "serafuku\n\n  1girl", "last"]
    panels = [3, 1, 2, 9, 3, None, -4]
    rows = spark.createDataFrame([(p, t, "x", 5) for p, t in zip(panels, texts)], "panel long, positive string, key string, start int").repartition(3)
    folder = f"file://{tmp_path}/prompts"
    records.write_prompt_records(rows, vocabulary(BYTE_VOCABULARY), folder)
    got = records.read_prompt_records(spark, folder, kind="long", stretch=2)
    assert got.columns == ["panel", "start", "ids"]
    out = got.collect()
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts}
    want = sorted([(p, np.array(ids[t], "<u4").tobytes()) for p, t in zip(panels, texts)], key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted([(r["panel"], bytes(r["ids"])) for r in out], key=lambda x: (x[0] is not None, x[0] or 0)) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):  # ascending, without a gap, nulls first
        assert r["start"] == at
        at += len(r["ids"]) // 4
    keys = [r["panel"] for r in sorted(out, key=lambda r: r["start"])]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    shuffled = records.read_prompt_records(spark, folder, kind="long", seed=3).collect()
    assert Counter(shuffled) == Counter(out)
    # the files: index entries point at whole records, and damage is seen
    listed = json.loads((tmp_path / "prompts/_records.json").read_text())
    assert listed["ids"] == at and sum(f["records"] for f in listed["files"]) == len(rows.collect())
    name = next(f["name"] for f in listed["files"] if f["records"])
    path = tmp_path / f"prompts/{name}.records"
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_prompt_records(spark, folder).collect()


def test_no_prompts(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    records.write_prompt_records(spark.createDataFrame([], "panel long, positive string"), vocabulary(BYTE_VOCABULARY), folder)
    assert records.read_prompt_records(spark, folder).count() == 0


def test_record_query(spark, library):
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op11_records"](spark, FOLDER).collect())) == want


def test_word_counts(spark):
    lines = spark.createDataFrame([("1", "Été, été ÉTÉ a-b naïve", 1), (None, "naïve NAÏVE", 2), ("3", None, 3), ("4", "", 4), ("5", "x" * 50_000, 5)], "panel string, text string, n int")
    assert dict(spelling.count_words(lines).collect()) == {"Été": 1, "été": 1, "ÉtÉ": 1, "a": 1, "b": 1, "naïve": 2, "naÏve": 1, "x" * 50_000: 1}
    one = dict(spelling.count_words(lines.where("panel = '1'"), slip=1).collect())  # every word loses a letter
    def cut(w):
        h = zlib.crc32(f"1:{w}".encode()) % len(w)
        return w[:h] + w[h + 1:]
    assert one == dict(Counter(map(cut, ["Été", "été", "ÉtÉ", "a", "b", "naïve"])))


def slow_variants(counts, least, letters, ratio):
    counts = {w: n for w, n in counts.items() if n >= least and len(w) >= letters}
    near = defaultdict(list)
    for a, b in combinations(sorted(counts), 2):
        cuts = lambda w: {w[:i] + w[i + 1:] for i in range(len(w))}
        swap = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        if swap or a in cuts(b) or b in cuts(a):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in counts:
        top = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


def test_spelling_variants(spark):
    r = random.Random(4)
    counts = {}
    for _ in range(60):
        w = "".join(r.choice("abcé") for _ in range(r.randint(2, 7)))
        for _ in range(12):  # a family of words few edits apart
            counts[w] = r.choice([1, 2, 9, 40, 41, 300, 2000])
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abcé漢") + w[i:], w[:i] + w[i + 1:], w[:i] + "é" + w[i + 1:]]) or "a"
    rows = [(w, n - 1, "x") for w, n in counts.items()] + [(w, 1, "y") for w in counts] + [(None, 99, "z")]
    words = spark.createDataFrame(rows, "word string, n long, cell string")
    for piece in (7, 1024):
        got = spelling.spelling_variants(words, 2, 3, 5, piece=piece).select("word", "form", "root", "n", "n_near", "form_n")
        assert set(map(tuple, got.collect())) == slow_variants(counts, 2, 3, 5)
    assert spelling.spelling_variants(words.limit(0)).count() == 0


def test_long_words_are_near():
    a = "q" * 30_000 + "x" + "é" * 9000
    assert spelling.near_pairs([a, "short"], [a.replace("x", ""), a.replace("x", "y"), a], False) == [(0, 0), (0, 1)]


def slow_phrases(rows, least, top):
    f, total = Counter(), Counter()
    for g, text in rows:
        g = "und" if g is None else g
        for p in "".join("\n" if c in ".,;:!?\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text or "").split("\n"):
            w = [x for x in p.replace("\t", " ").split(" ") if x]
            total[g] += len(w)
            for k in (1, 2, 3):
                f.update((g, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    best = defaultdict(list)
    for (g, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        s, _, l, r = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        if not any(len(v) == 3 and h == g and w in (v[:2], v[1:]) and n >= least and 100 * n >= 50 * a for (h, v), n in f.items() if len(w) == 2):
            best[g].append((-s, -a, " ".join(w).encode(), l, r))
    return {(g, i, p.decode(), -a, l, r, total[g], -s) for g, x in best.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def test_collocations(spark):
    r = random.Random(6)
    words = ["red", "Coat", "the", "É", "a", " x", "\x1cy", "日本"]
    def text():
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ". "]) for _ in range(r.randint(0, 40)))
    rows = [(r.choice(["en", "en", "de", None, ""]), text(), i) for i in range(150)]
    rows += [("en", None, 0), (None, "", 0), ("en", "red coat " * 3000, 0)] + [("de", "the same row", 0)] * 20
    df = spark.createDataFrame(rows, "heading string, body string, n int").repartition(5)
    want = slow_phrases([x[:2] for x in rows], 10, 25)
    got = phrases.collocations(df, top=25)
    assert got.columns == ["heading", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(map(tuple, got.collect())) == want
    # counters too few for the mass: the partitions are merged again with enough
    assert set(map(tuple, phrases.collocations(df, top=25, parts=4, capacity=2).collect())) == want
    assert phrases.collocations(df.limit(0)).count() == 0


def test_summaries_lose_no_frequent_key():
    r = np.random.default_rng(8)
    keys = r.zipf(1.3, 200_000).astype(np.uint64)
    true = Counter(keys.tolist())
    s = phrases.Summary(len(keys) // 50 + 1)
    for part in np.array_split(keys, 40):  # each part is a summary of its own before it is merged
        t = phrases.Summary(s.capacity)
        t.merge(*phrases.added(part, np.ones(len(part), np.int64)))
        t.settle()
        s.merge(t.keys, t.counts, t.error)
    got = set(s.possible(50).tolist())
    assert s.error < 50 and len(s.keys) <= s.capacity
    assert {k for k, n in true.items() if n >= 50} <= got


def test_two_phrases_of_one_hash_are_counted_apart():
    s = phrases._Stretch(np.array([1, 2, 0, 3, 0, 1]), np.zeros(6, np.int32), [b"\xff", b"a", b"b", b"c"], np.zeros(4, np.uint64), ["en"])
    places = np.array([0, 1, 3, 5])
    assert sorted(zip(*[x if isinstance(x, list) else x.tolist() for x in phrases._phrases(s, 1, places, np.zeros(4, np.uint64))])) == [("en", b"a", 2), ("en", b"b", 1), ("en", b"c", 1)]
