"""Rows that once ended a job, lost text or passed a check."""

from pyspark.sql import functions as F

from folioflow.functions import boxes, fixed, seeds
from folioflow.operators import aggregates, assembly, joins, rules, sections, shape, windows

H = ["## 分镜编号与位置", "## 出场人物", "## 备注"]


def test_headings_keep_all_text(spark):
    text = "### 出场人物：A、B\nC\n## unknown\nstays\n## 分镜编号与位置\none\n## 出场人物\nagain"
    df = spark.createDataFrame([(1, text), (2, None), (3, "lead\n# 备注\nend")], "k int, text string")
    got = {r["k"]: r["text"] for r in sections.repair_headings(df, "text", H, {H[2]: F.lit("spare")}).collect()}
    assert got[1] == f"{H[0]}\none\n## 出场人物\nagain\n\n{H[1]}\n：A、B\nC\n## unknown\nstays\n\n{H[2]}\nspare"
    assert got[2] == f"{H[0]}\n{fixed.NO_TEXT}\n\n{H[1]}\n{fixed.NO_TEXT}\n\n{H[2]}\nspare"
    assert got[3] == f"{H[0]}\nlead\n\n{H[1]}\n{fixed.NO_TEXT}\n\n{H[2]}\nend"


def test_quarantine_keeps_all_errors(spark):
    df = spark.createDataFrame([(1, ["e%d" % i for i in range(25)]), (2, []), (3, None)], "k int, errors array<string>")
    good, bad = shape.quarantine(df, "errors")
    assert [r["k"] for r in good.collect()] == [2]
    assert {r["k"]: (r["error_count"], len(r["errors"] or [])) for r in bad.collect()} == {1: (25, 25), 3: (0, 0)}


def test_sizes_and_ratios_without_a_divisor(spark):
    df = spark.createDataFrame([(100.0, 0.0), (None, 5.0), (100.0, 400.0)], "w double, h double")
    assert [r[0] for r in df.select(boxes.shape_of(F.col("w"), F.col("h"))).collect()] == [None, None, "vertical"]
    runs = spark.createDataFrame([("s1", 0.0), ("s2", 4.0)], "stage string, seconds double")
    assert {r["stage"]: r["reduction_pct"] for r in aggregates.stage_benchmark(runs, runs, "stage", "seconds").collect()} == {"s1": None, "s2": 0.0}
    jobs = spark.createDataFrame([("a", 5.0, 0.0)], "k string, wall double, out double")
    assert aggregates.render_rate(jobs, ["k"], "wall", "out").first()["seconds_per_second"] is None


def test_overlong_numbers_are_errors(spark):
    text = "[Shot 1] x [Shot 99999999999] At 00:01.000"
    df = spark.createDataFrame([(text,), ("[Shot 1] x [Shot 2147483646] At 00:01.000",)], "t string")
    for r in df.select(windows.shot_errors(F.col("t"), F.lit(9.0)).alias("e")).collect():
        assert "shot numbers not contiguous" in r["e"]
    log = spark.createDataFrame([("Duration: 00:00:03.00 Video: h264 640x480 Audio: aac 99999999999999 Hz",)], "log string")
    r = assembly.media_from_logs(log, "log").first()
    assert (r["w"], r["sample_rate"]) == (640, fixed.RATE_DEFAULT)


def test_nulls_do_not_pass(spark):
    df = spark.createDataFrame([(None, None, None)], "prompt string, mode string, lines array<string>")
    e = df.select(rules.prompt_errors(F.col("prompt"), F.col("mode"), F.lit(5.0), F.col("lines"), F.col("lines")).alias("e")).first()["e"]
    assert {"mode missing", "lock phrase", "shot 1 missing", "start field"} <= set(e)
    e = df.select(rules.segment_script_errors(F.col("prompt"), F.lit(5.0), F.col("lines")).alias("e")).first()["e"]
    assert "no seconds" in e and len(e) > 1
    wanted = spark.createDataFrame([(1, "said"), (2, "said"), (3, "said")], "k int, w string")
    docs = spark.createDataFrame([(1, None), (3, "he said so")], "k int, t string")
    assert {r["k"] for r in joins.verbatim_missing(wanted, docs, ["k"], "w", "t").collect()} == {1, 2}


def test_scores(spark):
    df = spark.createDataFrame([("8.0",), ("8.9",), ("x",), ("11",), (None,)], "s string")
    assert [r[0] for r in df.select(seeds.score(F.col("s"))).collect()] == [8, 8, 0, 10, 0]
