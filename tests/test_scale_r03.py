"""Scans, lookups and streams that shuffle or call once where they did many times: same results, smaller plans."""

import random

from pyspark.sql import functions as F

from folioflow.operators import intervals as iv, joins, scan, sets
from folioflow.plans import jobs
from folioflow.streaming import streams as st


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _states(spark, n=400):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, lo, lo + rng.randint(-2, 9)) for i in range(n) for lo in [rng.randint(1, 50)]]
    return spark.createDataFrame(rows, "k string, ord long, lo long, hi long")


def _rows(df):
    return sorted(df.collect(), key=repr)


def test_small_keys_are_shuffled_once(spark):
    d = scan.ordered_scan(_states(spark), ["k"], ["lo", "hi", "ord"], max_before={"seen": F.col("hi")})
    assert _plan(d).count("Exchange hashpartitioning") == 1


def test_large_keys_are_cut_with_the_same_result(spark, monkeypatch):
    s = _states(spark)
    required = spark.range(1, 61).withColumnRenamed("id", "pos")
    facts = s.select("k", (F.col("lo") + 3).alias("pos"), "hi")

    def run():
        order = ["lo", "hi", "ord"]
        return [_rows(d) for d in (
            scan.ordered_scan(s, ["k"], order, iv._span_blocks("lo", "hi", "ord"), row_number="n", sums={"t": F.col("hi")}, previous={"p": F.col("hi")}, max_before={"m": F.col("hi")}),
            iv.interval_errors(s, required, ["k"], "pos"), iv.coverage_gaps(s, required, ["k"], "pos"), iv.normalise_states(s, ["k"], 5, 45),
            iv.repair_states(s, required, ["k"], "pos", 1, 60), iv.state_at(facts, s, ["k"], "pos", payload=["lo"], policy="earliest_start"),
            iv.state_at(facts, s, ["k"], "pos", policy="latest_listed"))]

    whole = run()
    assert scan.large_keys(s, ["k"]) is None
    monkeypatch.setattr(scan, "LARGE", 100)
    assert [r["k"] for r in scan.large_keys(s, ["k"]).collect()] == ["a"]
    assert run() == whole


def test_interval_errors_scan_states_once(spark, monkeypatch):
    seen = []
    real = iv.ordered_scan
    monkeypatch.setattr(iv, "ordered_scan", lambda *a, **kw: seen.append(1) or real(*a, **kw))
    iv.interval_errors(_states(spark), spark.range(1, 61).withColumnRenamed("id", "pos"), ["k"], "pos")
    assert len(seen) == 1


def test_states_are_reduced_without_shuffling_their_nodes(spark):
    s = _states(spark)
    plan = _plan(iv.state_at(s.select("k", F.col("lo").alias("pos")), s, ["k"], "pos", policy="latest_listed"))
    assert "REPARTITION_BY_NUM" in plan


def test_missing_tags_are_found_inside_the_row(spark):
    panels = spark.createDataFrame([(1, 0, "rain", "", "lowres", 800, 1000), (2, 0, "sun", "", "lowres", 800, 1000)], "panel int, o int, scene string, tail string, negative string, crop_w int, crop_h int")
    mentions = spark.createDataFrame([(1, 1, "x", 3), (1, 2, "y", 3), (9, 1, "x", 3), (None, 1, "y", 3)], "panel int, o int, entity string, page int")
    entities = spark.createDataFrame([("x", "X", "red hair, hat", "female"), ("y", "Y", "cloak", "male")], "entity string, anchor string, tags string, gender string")
    states = spark.createDataFrame([("x", 1, 1, 5, "coat")], "entity string, ord long, lo long, hi long, state_tags string")
    out = jobs.prompts(panels, mentions, entities, states, "panel", "entity", "page", ["o"], "run")
    assert _plan(out["missing"]).count("Generate") == 1
    assert sorted((r["panel"] or 0, r["entity"], r["tag"]) for r in out["missing"].collect()) == [(0, "y", "cloak"), (9, "x", "coat"), (9, "x", "hat"), (9, "x", "red hair")]


def test_cover_counts_units_once(spark):
    used = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 3, 3), (1, 3, 4), (1, 8, 5), (None, 5, 6)], "k int, unit int, at int")
    units = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (None, 5)], "k int, unit int")
    d = sets.exact_cover(used, units, ["k"], "unit", ["at"], ["unit"])
    assert sorted((r["k"] or 0, r["unit"], r["problem"]) for r in d.collect()) == [
        (0, 5, "missing"), (0, 5, "unknown"), (1, 1, "order"), (1, 2, "order"), (1, 3, "duplicate"), (1, 4, "missing"), (1, 8, "unknown")]
    assert "Aggregate" not in _plan(d)


def test_words_meet_stored_anchors(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog ran")], "d int, t string")
    phrases = spark.createDataFrame([(1, "cat sat on"), (2, "og ra"), (3, "ca")], "p int, s string")
    d = joins.phrase_hits(docs, "d", "t", phrases, "p", "s")
    assert sorted(map(tuple, d.collect())) == [(1, 1), (1, 3), (2, 2)]
    assert "anchors-" in "".join(d.inputFiles())


def test_retries_keep_units_of_a_lane_together(spark, tmp_path):
    schema = "unit long, attempt int, passed boolean, points int, infra boolean"
    folder = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = st.stream_units(spark, folder, spark.createDataFrame([], schema).schema)
    assert "lane" in st.retry_machine(stream, "unit", "attempt", "passed", "points", "infra")._jdf.queryExecution().analyzed().toString()

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return st.run_to_table(st.retry_machine(stream, "unit", "attempt", "passed", "points", "infra"), "r", folder=str(tmp_path / "run"))

    go([(u, 1, False, 9, False) for u in range(50)] + [(None, 1, True, 9, False)])
    got = go([(u, 2, u % 2 == 0, 9, u == 7) for u in range(50)] + [(None, 2, False, 1, False)])
    late = sorted((r["unit"], r["used"], r["action"]) for r in got.where("attempt = 2").collect())
    assert late == [(u, 1 if u == 7 else 2, "failed" if u == 7 else "completed" if u % 2 == 0 else "retry") for u in range(50)]
    assert [(r["attempt"], r["action"]) for r in got.where("unit IS NULL").collect()] == [(1, "completed")]
