"""Checks: one good record, then one change per rule."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import fixed
from folioflow.functions.clock import clock_seconds, shot_clock
from folioflow.functions.text import bare_name, clip_sentence, drop_cjk_tags, fill, page_of_path, unfilled, unit_path, unweight
from folioflow.operators import aggregates as ag, joins, rules, sections as sc, segments as sg, sets, windows as wn
from folioflow.operators.repair import repair_video_prompt

GOOD = (
    fixed.I2VA_FIRST_LINE + "\n\n" + fixed.PROMPT_FIELDS[0] + f" [Shot 1] ({fixed.LOCK_PHRASE}) Mina says <d>[Chinese] 你好 </d> [Shot 2] At 00:04.000, she runs."
    + "\n\n" + fixed.PROMPT_FIELDS[1] + " wind\n\n" + fixed.PROMPT_FIELDS[2] + " drums"
)
CASES = [
    (lambda s: s, "i2va", []),
    (lambda s: s.replace("00:04.000", "00:09.000"), "i2va", ["time out of range"]),
    (lambda s: s.replace("she runs.", "she runs. [Shot 3] At 00:03.000, x"), "i2va", ["times not increasing"]),
    (lambda s: s.replace(fixed.LOCK_PHRASE, ""), "i2va", ["lock phrase"]),
    (lambda s: s.replace("Mina", "Nina"), "i2va", ["name missing"]),
    (lambda s: s.replace(" </d>", ""), "i2va", ["tags unbalanced"]),
    (lambda s: s.replace("你好", "再见"), "i2va", ["dialogue not verbatim"]),
    (lambda s: "x" + s, "i2va", ["first line"]),
    (lambda s: s, "t2va", ["first line not allowed", "start field"]),
    (lambda s: s.replace("[Shot 1] (", "[Shot 1] At 00:01.000, ("), "i2va", ["shot 1 has a time", "timed shots incomplete"]),
    (lambda s: s.replace("[Shot 2]", "[Shot 3]"), "i2va", ["shot numbers not contiguous", "timed shots incomplete"]),
    (lambda s: s.replace(fixed.PROMPT_FIELDS[1], "sound:"), "i2va", ["missing overall_soundscape:"]),
]
COLS = ("prompt", "mode", "duration", "dialogue", "names")


def _prompts(spark):
    rows = [(i, f(GOOD), mode, 8.5, ["你好"], ["Mina"]) for i, (f, mode, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "i int, prompt string, mode string, duration double, dialogue array<string>, names array<string>")


def _errors(d):
    e = rules.prompt_errors(*[F.col(c) for c in COLS])
    return {r["i"]: list(r["e"]) for r in d.select("i", e.alias("e")).collect()}


def test_prompt_rules(spark):
    assert _errors(_prompts(spark)) == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_prompt_repair(spark):
    left = _errors(repair_video_prompt(_prompts(spark), *COLS))
    assert {i for i, e in left.items() if e} == {10}  # a gap in the shot numbers stays
    again = repair_video_prompt(repair_video_prompt(_prompts(spark).where("i = 0"), *COLS), *COLS).first()["prompt"]
    assert again.count(fixed.I2VA_FIRST_LINE) == 1 and "At 00:04.250" in again


def _one(spark, expr, **cols):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return d.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("tag,want", [("(red eyes:1.2)", "red eyes"), ("astolfo \\(fate\\)", "astolfo (fate)"), ("(re:zero)", "re:zero"), ("plain", "plain")])
def test_unweight(spark, tag, want):
    assert _one(spark, unweight(F.col("t")), t=tag) == want


def test_text_expressions(spark):
    assert _one(spark, drop_cjk_tags(F.col("t")), t="a, 银发, b") == "a, b"
    assert _one(spark, bare_name(F.col("t")), t="A・b (c)") == "Abc"
    assert _one(spark, unit_path(F.col("t")), t=".\\s2_zero\\00_settings.md") == "00_settings.json"
    assert _one(spark, page_of_path(F.col("t")), t="03_panels/p012_03.md") == 12
    assert _one(spark, fill(F.col("t"), {"A": F.lit("1")}), t="<<A>>-<<B>>") == "1-<<B>>"
    assert _one(spark, unfilled(F.col("t")), t="1-<<B>>") == ["B"]
    assert _one(spark, clip_sentence(F.col("t"), 10), t="一二三四五六七。八九十") == "一二三四五六七。……"
    assert _one(spark, clip_sentence(F.col("t"), 10), t="一。二三四五六七八九十") == "一。二三四五六七八九……"
    assert _one(spark, clock_seconds(F.col("t")), t="01:01:01.5") == 3661.5
    assert _one(spark, clock_seconds(F.col("t")), t="1x") is None
    assert _one(spark, shot_clock(F.col("t")), t=61.25) == "01:01.250"


def _doc(headings):
    return "\n".join(f"{h}\nbody {i}" for i, h in enumerate(headings))


@pytest.mark.parametrize("change,want", [
    (lambda h: h, []), (lambda h: h[:3] + h[4:], ["missing " + fixed.PANEL_HEADINGS[3]]),
    (lambda h: h[:1] + [h[2], h[1]] + h[3:], ["order " + fixed.PANEL_HEADINGS[2]]),
])
def test_headings(spark, change, want):
    heads = fixed.PANEL_HEADINGS
    d = spark.createDataFrame([(_doc(change(list(heads))),)], "text string")
    assert sc.check_headings(d, "text", heads).first()["errors"] == want
    fixed_doc = sc.repair_headings(d, "text", heads, {})
    assert sc.check_headings(fixed_doc, "text", heads).first()["errors"] == []


def test_repair_headings_level_lead_and_blank(spark):
    heads = fixed.PANEL_HEADINGS
    text = "lead\n" + "\n".join(("#" if i == 2 else "") + h + ("\n" if i == 5 else f"\nb{i}") for i, h in enumerate(heads) if i)
    d = spark.createDataFrame([(text,)], "text string")
    got = sc.repair_headings(d, "text", heads, {heads[5]: F.lit("spare")}).first()["text"]
    assert got.startswith(heads[0] + "\nlead\n\n" + heads[1] + "\nb1\n\n" + heads[2] + "\nb2") and heads[5] + "\nspare" in got


def test_dialogue_lines(spark):
    body = "- 美娜：你好：吗\n（无）\n（本镜无对白）\nplain words\nJo: hi\n"
    d = spark.createDataFrame([(1, body)], "id int, body string")
    got = [(r["speaker"], r["text"]) for r in sc.dialogue_table(d, ["id"], "body").orderBy("pos").collect()]
    assert got == [("美娜", "你好：吗"), ("?", "plain words"), ("Jo", "hi")]


def test_attempts(spark):
    rows = [("a", 0, True, "8", False), ("b", 0, True, "6", False), ("b", 1, True, "8", False), ("c", 0, False, "9", False),
            ("c", 1, True, "3", False), ("c", 2, False, "5", False), ("d", 0, True, "6", False), ("e", 0, None, None, True)]
    d = spark.createDataFrame(rows, "unit string, attempt int, passed boolean, points string, infra boolean")
    got = {r["unit"]: (r["final_attempt"], r["best_attempt"], r["status"]) for r in ag.final_attempt(d, ["unit"], "attempt", "passed", "points", "infra").collect()}
    assert got == {"a": (0, 0, "completed"), "b": (1, 1, "completed"), "c": (2, 0, "needs_review"), "d": (0, 0, "pending"), "e": (None, None, "failed")}


def test_crossfade_and_packing(spark):
    d = spark.createDataFrame([("v", 1, 3.0), ("v", 2, 3.0), ("w", 1, 4.0)], "k string, seq long, d double")
    got = {(r["k"], r["seq"]): r["offset"] for r in wn.crossfade_offsets(d, ["k"], ["seq"], "d").collect()}
    assert got == {("v", 1): None, ("v", 2): 2.55, ("w", 1): None}
    assert {r["k"]: r["total"] for r in wn.crossfade_total(d, ["k"], "d").collect()} == {"v": 5.55, "w": 4.0}
    units = spark.range(7).select(F.lit("k").alias("k"), F.col("id").alias("u"))
    sizes = sg.pack_sequential(units, ["k"], ["u"]).groupBy("seg").count().orderBy("seg")
    assert [r["count"] for r in sizes.collect()] == [3, 3, 1]


def test_half_split_keeps_units(spark):
    d = spark.createDataFrame([(1, 7, 100.0), (2, 1, 40.0), (3, 2, 0.5)], "seg int, n long, d double")
    got = sg.half_split(d, ["seg"], "n", "d").orderBy("seg", "part_from").collect()
    assert [r["part_units"] for r in got if r["seg"] == 1] == [1] * 7
    assert [(r["part_units"], r["part_seconds"]) for r in got if r["seg"] > 1] == [(1, 15.0), (2, 1.0)]
    seven = [r["part_seconds"] for r in got if r["seg"] == 1]
    assert all(abs(s - 100 / 7) < 0.05 for s in seven)


def test_exact_cover(spark):
    units = spark.createDataFrame([("k", u) for u in range(6)], "k string, unit long")
    used = spark.createDataFrame([("k", 0, 0), ("k", 2, 1), ("k", 1, 2), ("k", 3, 3), ("k", 3, 4), ("k", 9, 5)], "k string, unit long, pos long")
    got = {(r["unit"], r["problem"]) for r in sets.exact_cover(used, units, ["k"], "unit", ["pos"], ["unit"]).collect()}
    assert got == {(4, "missing"), (5, "missing"), (3, "duplicate"), (9, "unknown"), (1, "order"), (2, "order")}


def test_skip_cascade(spark):
    rows = [("r", s, "completed", 1) for s in ("s0", "s1", "s2")] + [("r", "s3", "failed", 2)]
    d = spark.createDataFrame(rows, "run string, stage string, status string, ts long")
    got = {r["stage"]: r["state"] for r in joins.stage_states(d, "run", "stage", "status").collect()}
    assert {s for s, v in got.items() if v == "skipped"} == {"s4", "s4b"} and {s for s, v in got.items() if v == "ready"} == {"s5"}


@pytest.mark.parametrize("phrase", ["b c", "bc de fg", "ab", "c d", "x\ny", " b", "fg ", "de"])
def test_phrase_hits_against_contains(spark, phrase):
    texts = ["ab cd", "abc def", "a bc de fgh", "x\ny b", "zz", "b c", "fg", "fg h", "abab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ph = spark.createDataFrame([(0, phrase)], "p int, s string")
    got = sorted(r["i"] for r in joins.phrase_hits(docs, "i", "t", ph, "p", "s").collect())
    assert got == [i for i, t in enumerate(texts) if phrase in t]


def test_loose_names_against_every_pair(spark):
    names = ["ann", "joann", "an", "a", "b", "ab", "a b", "“Ann”", "annann", "n", "", None, "ana", "nana", "安娜", "小安娜", "娜", "xanax"]
    a = spark.createDataFrame([(x,) for x in names], "x string")
    got = {(r["a"], r["b"]) for r in joins.fuzzy_name_join(a, "x", a.withColumnRenamed("x", "y"), "y").collect()}
    bare = {x: "".join(c for c in x if c not in " “”") for x in names if x is not None}

    def meets(x, y):
        return x != "" and y != "" and (x == y or (min(len(x), len(y)) >= 2 and (x in y or y in x)))

    assert got == {(x, y) for x in bare for y in bare if meets(bare[x], bare[y])}


def test_phrases_of_one_id_and_common_words(spark):
    docs = spark.createDataFrame([(i, f"the word{i} of the house {'and' * (i % 2)} garden") for i in range(20)] + [(20, None), (21, "")], "i int, t string")
    ph = spark.createDataFrame([(0, "x word3 of the y"), (1, "the word3 of"), (1, "word4 of the house"), (2, "of the house"), (3, "no such thing here"), (4, None), (5, " ")], "p int, s string")
    got = sorted(tuple(r) for r in joins.phrase_hits(docs, "i", "t", ph, "p", "s").distinct().collect())
    assert got == sorted([(3, 1), (4, 1)] + [(i, 2) for i in range(20)])


def test_final_segments(spark):
    units = spark.createDataFrame([(k, u) for k in "abcd" for u in range(1, 7)], "k string, u long")
    rows = [("a", s, u, u, 40.0, "  ") for s, us in ((1, (1, 2, 3, 4)), (2, (5, 6))) for u in us]  # right, too long
    rows += [("b", 1, u, u, 9.0, "x") for u in (1, 2, 3, 4, 6)]  # one is missing
    rows += [("c", 1, p, u, 9.0, "x") for p, u in enumerate((1, 2, 2, 3, 4, 5, 6))]  # one twice in its segment
    rows += [("d", 1, u, u, None, "y") for u in (1, 2, 3, 9)] + [("d", 2, u, u, 0.0, None) for u in (3, 4, 5, 6)]  # unknown and repeated ones are left out
    used = spark.createDataFrame(rows, "k string, seg long, pos long, u long, d double, beat string")
    segs, members = sg.final_segments(used, units, ["k"], "seg", "pos", "u", ["u"], "d", "beat")
    got = {k: [tuple(r)[1:] for r in segs.where(F.col("k") == k).orderBy("seg").collect()] for k in "abcd"}
    none = fixed.FALLBACK_BEAT
    assert got["a"] == [(i, 1, 10.0, none, "salvaged") for i in (1, 2, 3, 4)] + [(i, 1, 15.0, none, "salvaged") for i in (5, 6)]
    assert got["b"] == got["c"] == [(1, 3, 15.0, none, "packed"), (2, 3, 15.0, none, "packed")]
    assert got["d"] == [(1, 3, 15.0, "y", "salvaged"), (2, 3, 15.0, none, "salvaged")]  # 20 s each, three of four units left
    assert [r["u"] for r in members.where("k = 'd'").orderBy("seg", "pos").collect()] == [1, 2, 3, 4, 5, 6]
    empty = sg.final_segments(used.limit(0), units, ["k"], "seg", "pos", "u", ["u"], "d", "beat")[0]
    assert {r["how"] for r in empty.collect()} == {"packed"} and empty.count() == 8


def test_sketches_merge_to_stated_ranks(spark):
    d = spark.range(60000).select(F.when(F.col("id") < 40000, "a").otherwise("b").alias("k"), (F.col("id") % 24).alias("h"), ((F.col("id") * 7919) % 60013).cast("double").alias("v"))
    d = d.unionByName(spark.createDataFrame([("a", 1, None), ("c", 1, 5.0), (None, 2, float("nan"))], "k string, h long, v double"))
    got = {(r["k"], r["level"]): r for r in ag.latency_from_sketches(ag.latency_sketches(d, ["k", "h"], "v"), ["k"], rollup=True).collect()}
    values = {"a": [(i * 7919) % 60013 for i in range(40000)], "b": [(i * 7919) % 60013 for i in range(40000, 60000)]}
    values[None] = values["a"] + values["b"] + [5]
    for k, v in values.items():
        r = got[(k, 0 if k else 1)]
        assert r["n"] == len(v) and r["max"] == max(v)
        for name, q in (("median", 0.5), ("p90", 0.9)):
            assert abs(sum(x <= r[name] for x in v) / len(v) - q) <= 2 * ag.sketch_error(2000)
    assert got[("c", 0)]["median"] == 5.0 and set(got) == {("a", 0), ("b", 0), ("c", 0), (None, 1)}
