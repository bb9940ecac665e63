"""Rows that used to get lost: wide intervals, nested records, log lines that go on, unreadable runs, calls that raise."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import fixed
from folioflow.operators import assembly as asm, enrich as en, intervals as iv, rules, shape
from folioflow.sources import documents


@pytest.mark.parametrize("lo, hi", [(0, 1_700_000_000), (-1_700_000_001, 5), (7, 7), (63, 64), (-64, 127), (1, 4_500_000_000_000)])
def test_wide_intervals_have_few_nodes(spark, lo, hi):
    d = spark.createDataFrame([("k", lo, hi)], "k string, lo long, hi long")
    levels = iv.levels_of(d, "lo", "hi")
    nodes = iv.interval_nodes(d, "lo", "hi", levels).collect()
    assert len(nodes) < 1000 and sum(64 ** r["level"] for r in nodes) == hi - lo + 1  # each position once
    points = [p for p in {lo - 1, lo, lo + 1, (lo + hi) // 2, hi - 1, hi, hi + 1, 0, 64, 4095}]
    facts = spark.createDataFrame([("k", p) for p in points], "k string, pos long")
    got = {r["pos"] for r in iv.covering_pairs(facts, d, ["k"], "pos", "lo", "hi").collect()}
    assert got == {p for p in points if lo <= p <= hi}


def test_no_states(spark):
    facts = spark.createDataFrame([("k", 1)], "k string, pos int")
    states = spark.createDataFrame([], "k string, lo int, hi int, ord int")
    assert iv.state_at(facts, states, ["k"], "pos", policy="latest_listed").collect()[0]["state_ord"] is None


def test_records_in_lists_and_wrappers(spark):
    one = [{"name": "A"}]
    cases = {
        1: ([{"x": 1}, {"characters": one}], one, None),
        2: ({"a": {"b": 1}, "settings": {"Chars": one, "Style": "ink"}}, one, None),
        3: ([[{"deep": [{"CHARACTER_LIST": one}]}]], one, None),
        4: ({"characters": [{"name": "A", "notes": "of A"}]}, [{"name": "A", "notes": "of A"}], None),
        5: (one, one, None), 6: ({"name": "A"}, one, None),
        7: ({"x": {"y": 1}}, "", "no record"), 8: ([], "", "no record"), 9: ("text", "", "no record"), 11: ({"a": {"b": {"c": {"d": {"chars": one}}}}}, "", "no record"),
    }
    rows = [(i, json.dumps(v[0])) for i, v in cases.items()] + [(20, '{"characters": ['), (21, None), (22, "")]
    d = shape.unify_aliases(spark.createDataFrame(rows, "i int, raw string"), "raw", fixed.RECORD_ALIASES, bare=("characters", "name"), error="wrong")
    got = {r["i"]: r for r in d.collect()}
    for i, (_, want, error) in cases.items():
        assert (json.loads(got[i]["characters"]) if got[i]["characters"] else "") == want and got[i]["wrong"] == error, i
    assert [got[i]["wrong"] for i in (20, 21, 22)] == ["not JSON"] * 3
    assert got[2]["style_notes"] == "ink" and got[4]["style_notes"] == ""  # the notes are A's, not the record's


def test_lines_that_go_on(spark, tmp_path):
    head = "2026-09-28 12:00:0{},000 [{}] {}"
    (tmp_path / "s2.log").write_text("\n".join([
        "before all", head.format(1, "ERROR", "attempt 1 failed: y"), "Traceback:", '  File "x"', "", head.format(2, "INFO", "[llm] ttft=0.4s total=9.5s content=7c reasoning=31c decode=9.1s")]) + "\n")
    (tmp_path / "s3.log").write_text("only\nnoise\n")
    records, more = documents.read_stage_logs(spark, str(tmp_path))
    r1, r2 = sorted(records.collect(), key=lambda r: r["ord"])
    assert (r1["stage"], r1["more_lines"], r1["failed"], r2["more_lines"]) == ("s2", 3, True, 0)
    assert tuple(r2[c] for c in ("ttft_seconds", "total_seconds", "decode_seconds", "content_chars", "reasoning_chars")) == (0.4, 9.5, 9.1, 7, 31)
    rest = sorted(more.collect(), key=lambda r: (r["file"], r["ord"]))
    assert [(r["stage"], r["line"], r["record_ord"] == r1["ord"] if r["record_ord"] is not None else None) for r in rest] == [
        ("s2", "before all", None), ("s2", "Traceback:", True), ("s2", '  File "x"', True), ("s2", "", True), ("s3", "only", None), ("s3", "noise", None)]


def test_lines_go_on_over_blocks_and_null_keys(spark):
    line = "2026-09-28 12:00:01,000 [INFO] m"
    rows = [(None, b, o, line if (b, o) in ((0, 1), (3, 30)) else f"{b}{o}", "x") for b, o in ((0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (3, 29), (3, 30), (3, 31), (7, 70))]
    records, more = documents.stitch_log_lines(spark.createDataFrame(rows, "f string, b int, o int, line string, part string"), "line", ["f"], "b", "o")
    assert {r["o"]: r["more_lines"] for r in records.collect()} == {1: 4, 30: 2}
    assert {r["o"]: r["record_ord"] for r in more.collect()} == {0: None, 2: 1, 3: 1, 4: 1, 29: 1, 31: 30, 70: 30}


def test_unreadable_runs_are_kept(spark, tmp_path):
    good = {"id": "r1", "stages": {"s0": {"status": "completed", "items": {"a": {"status": "failed", "data": {"x": 1}}}}}}
    for name, text in {"a.json": json.dumps(good), "b.json": '{"id": "r2", "stages": {', "c.json": '{"id": "r3"}', "d.json": '{"id": "r4", "stages": {"s0": 5, "s1": {"status": "completed"}}}'}.items():
        (tmp_path / name).write_text(text)
    rows, bad = documents.read_ledger(spark, str(tmp_path))
    assert {(r["run_id"], r["stage"], r["item"], r["status"]) for r in rows.collect()} == {("r1", "s0", None, "completed"), ("r1", "s0", "a", "failed")}
    assert {r["run_id"]: r["error"] for r in bad.collect()} == {"b.json": "not JSON", "r3": "no stages", "r4": "bad stage s0"}


def test_a_call_that_raises_costs_its_own_rows_only(spark):
    d = spark.range(0, 50, 1, 2).select(F.col("id").alias("i"))

    def call(rows, errors):
        if (rows["i"] == 7).any() or ((rows["i"] == 33) & (errors == "")).any():
            raise RuntimeError("model gone")
        return rows["i"].to_frame("o")

    def validate(out):
        if (out["o"] == 40).any():
            raise KeyError("o")
        return out["o"].map(lambda v: [])

    good, bad = en.enrich(d, call, "o long", validate, lanes=2)
    assert sorted(r["i"] for r in good.collect()) == [i for i in range(50) if i not in (7, 40)]
    assert good.where("i = 33").first()["attempts"] == 2 and good.where("i <> 33 AND attempts > 1").count() == 0
    assert {(r["i"], r["attempts"], r["error"]) for r in bad.collect()} == {(7, 2, "RuntimeError: model gone"), (40, 2, "KeyError: 'o'")}


def test_one_prompt_whatever_the_cast(spark):
    n = 2500
    cast = spark.range(n).select(F.lit("p1").alias("panel"), F.col("id").alias("ord"), F.concat(F.lit("e"), "id").alias("name"), F.lit("").alias("anchor"), F.concat(F.lit("t"), "id").alias("tags"),
                                 F.lit("").alias("state_tags"), F.when(F.col("id") == 7, "Girl").otherwise("-").alias("gender"))
    cast = cast.unionByName(spark.createDataFrame([("p2", 1, "x", "a1", "", "", "boy"), ("p2", 0, "y", "", "", "", "boy"), ("p9", 0, "z", "", "", "", None)], "panel string, ord long, name string, anchor string, tags string, state_tags string, gender string"))
    panels = spark.createDataFrame([("p1", 4, "forest", "", "lowres", 800, 1000), ("p2", 5, "", None, None, None, 0), ("p3", 6, None, "x", "", 10, 0)],
                                   "panel string, page int, scene string, tail string, negative string, crop_w int, crop_h int")
    got = {r["panel"]: r for r in asm.assemble_prompts(panels, cast, "panel", ["ord"], "run", entity="name", carry=["page"]).collect()}
    assert len(got) == 3 and got["p1"]["positive"] == "1girl, " + ", ".join(f"t{i}" for i in range(n)) + ", forest,masterpiece,best quality,"
    assert got["p1"]["characters"] == [f"e{i}" for i in range(n)] and (got["p1"]["page"], got["p1"]["crop_aspect"], got["p1"]["anchors"]) == (4, 0.8, [])
    assert (got["p2"]["positive"], got["p2"]["anchors"], got["p2"]["crop_aspect"]) == ("2boys, a1,masterpiece,best quality,", ["a1"], None)
    assert (got["p3"]["count_tag"], got["p3"]["positive"]) == ("no humans", "no humans,x,")

    prompts = panels.select("panel", "crop_w", "crop_h", F.lit("rain, 夜").alias("scene_tags"), F.lit("fine").alias("quality_tail"), F.lit("3girls").alias("count_tag"),
                            F.lit("").alias("size_bucket"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("").alias("positive"))
    now = spark.range(0, n, 1000).select(F.concat(F.lit("e"), "id").alias("name"), F.lit("A, 红").alias("anchor"), F.concat(F.lit("n"), "id").alias("tags"), F.lit("").alias("state_tags"), F.lit("boy").alias("gender"))
    fixed = {r["panel"]: r for r in asm.repair_prompts(prompts, cast, now, "panel", ["ord"]).collect()}
    assert len(fixed) == 3
    assert fixed["p1"]["positive"] == "3boys, " + ", ".join(f"A, n{i}" if i % 1000 == 0 else f"t{i}" for i in range(n)) + ", rain,fine,"
    assert fixed["p2"]["positive"] == "3girls, a1, rain,fine," and fixed["p3"]["positive"] == "3girls, rain,fine,"  # nobody known: the stored tag stays


def test_missing_crop_size_is_an_error(spark):
    rows = [("a", "x", "", 1024, 1408, "vertical", 700, 1000), ("b", "x", "", 1024, 1408, "vertical", None, 1000), ("c", "x", "", None, None, None, None, None), ("d", "x", "", None, 1408, "vertical", 700, 1000)]
    prompts = spark.createDataFrame(rows, "panel string, positive string, negative string, width int, height int, size_bucket string, crop_w int, crop_h int")
    cast = spark.createDataFrame([], "panel string, name string, anchor string")
    entities = spark.createDataFrame([], "name string, tags string, state_tags string")
    got = {(r["panel"], r["detail"]) for r in rules.check_prompts_set(prompts, cast, entities, "panel").where("rule = 'bucket'").collect()}
    assert got == {("b", "no crop size"), ("c", "no crop size"), ("d", "vertical")}
