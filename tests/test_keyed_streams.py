"""Streams that remember: waiting for inputs, handing units over, last writes. Files come one by one, in any order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioflow.streaming import keyed, streams as st

T0 = datetime(2024, 1, 1, 12)
DELAY = 2000  # minutes: longer than the shuffled files are apart, so no row is late


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def files(spark, folder, rows, schema, parts, seed=None):
    """Rows written as files of which a stream reads one per batch."""
    rows = list(rows)
    if seed is not None:
        random.Random(seed).shuffle(rows)
    for i in range(parts):
        if rows[i::parts]:
            spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return st.stream_units(spark, folder, spark.read.parquet(folder).schema, max_files=1)


def want_inputs(segments, prompts, frames):
    out = set()
    for k, i, t in segments:
        ps = [p for q, p in prompts if q == k and k is not None and p is not None and p <= t + 60]
        p = min(ps, default=None)
        fs = [f for q, f in frames if q == k and p is not None and f <= max(t, p) + 30]
        f = min(fs, default=None)
        out.add((k, i, at(t), at(p), at(f), "failed" if p is None else "ready", None if p is None else "t2va" if f is None else "i2va"))
    return out


def test_inputs_early_late_several_and_in_any_order(spark, tmp_path):
    segments = [("a", 1, 100), ("b", 2, 100), ("c", 3, 100), ("d", 4, 100), ("e", 5, 100), ("f", 6, 100), ("f", 7, 10), ("f", 8, 900), (None, 9, 50), ("g", 10, 100)]
    prompts = [("a", 20), ("b", 160), ("c", 161), ("d", 130), ("d", 110), ("e", 100), ("f", 95), (None, 50), ("g", 150), ("h", 1)]
    frames = [("a", 3), ("a", 101), ("b", 190), ("d", 141), ("e", 130), ("f", 900), ("g", 181)]
    expect = want_inputs(segments, prompts, frames)
    assert {r[1]: (r[5], r[6]) for r in expect} == {  # by hand, among them: early, late, several and no inputs
        1: ("ready", "i2va"), 2: ("ready", "i2va"), 3: ("failed", None), 4: ("ready", "t2va"), 5: ("ready", "i2va"), 6: ("ready", "t2va"), 7: ("failed", None),
        8: ("ready", "i2va"), 9: ("failed", None), 10: ("ready", "t2va")}
    schema = "k string, ts timestamp"
    for seed in (1, 2):
        out = str(tmp_path / f"out{seed}")
        d = tmp_path / str(seed)

        def run(more):  # files one by one in any order; what is later than all others comes in a second run
            s = files(spark, str(d / "s"), [] if more else [(k, i, at(t)) for k, i, t in segments], "k string, seg int, ts timestamp", 3, seed)
            p = files(spark, str(d / "p"), [] if more else [(k, at(t)) for k, t in prompts], schema, 2, seed)
            f = files(spark, str(d / "f"), more or [(k, at(t)) for k, t in frames], schema, 3, seed)
            return st.run_to_table(st.match_inputs(s, p, f, "k", "seg", "ts", "ts", "ts", delay=f"{DELAY} minutes"), "match", folder=out).collect()

        assert run([]) == []
        rows = run([("z", at(1000 + DELAY))])
        assert len(rows) == len(segments) and set(map(tuple, rows)) == expect
    last = spark.createDataFrame([(at(900),)], "t timestamp")  # the same by an end that the caller knows
    s, p, f = (st.stream_units(spark, str(d / n), spark.read.parquet(str(d / n)).schema) for n in "spf")
    rows = st.run_to_table(st.match_inputs(s, p, f, "k", "seg", "ts", "ts", "ts", ended=(last, "t")), "match").collect()
    assert len(rows) == len(segments) and set(map(tuple, rows)) == expect


def test_segments_wait_until_their_time_is_over(spark, tmp_path):
    """Without an end, a second run goes on with what the first one left waiting."""
    schema = "k string, seg int, ts timestamp"
    out = str(tmp_path / "out")

    def run(segments, frames):
        s = files(spark, str(tmp_path / "s"), segments, schema, 1)
        f = files(spark, str(tmp_path / "f"), frames, "k string, ts timestamp", 1)
        got = st.match_frames(s, f, "k", "seg", "ts", "ts", wait=30, delay="1 minute")
        return {r["seg"]: r["mode"] for r in st.run_to_table(got, "w", folder=out).collect()}

    assert run([("a", 1, at(0)), ("b", 2, at(0))], [("z", at(20))]) == {}
    assert run([("c", 3, at(20))], [("a", at(25))]) == {}  # the frame is there, but an earlier one may still come
    assert run([("d", 4, at(28))], [("z", at(29))]) == {1: "i2va"}
    assert run([("e", 5, at(40))], [("y", at(55))]) == {1: "i2va", 2: "t2va", 3: "t2va"}


def test_units_are_handed_on_once_and_swept_up_at_the_end(spark, tmp_path):
    schema = "run string, unit int, status string, lines int, ts timestamp"
    sink, state, folder = (str(tmp_path / n) for n in ("sink", "state", "led"))

    def run(*rows):
        led = files(spark, folder, rows, schema, 1)
        st.stream_final_units(led, "run", "unit", "status", "lines", "ts", sink, state).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(sink).select("run", "unit", "lines", "action", "swept").collect()))

    first = run(("r", 1, "completed", 3, at(1)), ("r", 2, "pending", 2, at(1)), ("r", 3, "needs_review", 0, at(2)), ("q", 1, "failed", 5, at(1)), ("r", None, "in_progress", None, at(1)))
    assert first == [("r", 1, 3, "process", False), ("r", 3, 0, "complete", False)]
    second = run(("r", 1, "completed", 3, at(3)), ("r", 4, "completed", None, at(4)), ("r", None, "failed", None, at(5)), ("r", 5, None, 0, at(5)))
    assert second == sorted([*first, ("r", 4, None, "complete", False), ("r", 2, 2, "process", True), ("r", 5, 0, "complete", True)], key=lambda r: r[:2])
    third = run(("r", 2, "completed", 2, at(9)), ("r", 6, "pending", 1, at(9)))
    assert [r for r in third if r not in second] == [("r", 6, 1, "process", True)] and len(third) == len(second) + 1


def test_last_write_wins_in_any_order(spark, tmp_path):
    r = random.Random(3)
    schema = "run string, stage string, item string, status string, data string, ts timestamp, seq int"
    rows = [(r.choice("ab"), r.choice(["s1", "s2"]), r.choice(["x", None]), r.choice(["completed", "failed", None]), str(i), at(r.randrange(40)), i) for i in range(120)]
    rows += [("n", "s1", "x", "old", "0", None, 1), ("n", "s1", "x", "new", "1", at(0), 0)]
    keys = ["run", "stage", "item"]
    best = {}
    for w in rows:
        k, order = w[:3], (w[5] is not None, w[5] or T0, w[6])
        if k not in best or order > best[k][0]:
            best[k] = order, w[3:5]
    out = str(tmp_path / "out")
    for half in (rows[:70], rows[70:]):  # the second run goes on from the state of the first
        stream = files(spark, str(tmp_path / "u"), half, schema, 4, seed=5)
        log = st.run_to_table(keyed.latest_writes(stream, keys, ["ts", "seq"], ["status", "data"]), "l", folder=out)
    got = keyed.current_writes(log, keys)
    assert {tuple(x)[:3]: (x["status"], x["data"]) for x in got.collect()} == {k: v for k, (_, v) in best.items()}
    versions = log.groupBy(*keys).agg(F.max("version").alias("m"), F.count("*").alias("n"), F.count_distinct("version").alias("d")).collect()
    assert all(v["m"] == v["n"] == v["d"] for v in versions)
    # a repeated or older write changes nothing
    again = files(spark, str(tmp_path / "u"), rows[:20], schema, 1)
    assert st.run_to_table(keyed.latest_writes(again, keys, ["ts", "seq"], ["status", "data"]), "l", folder=out).count() == log.count()


def test_last_windows_close(spark, tmp_path):
    schema = "kind string, seconds double, ts timestamp"
    rows = [("v", 50.0, at(0)), ("v", 10.0, at(10)), ("v", 60.0, at(20)), ("v", 70.0, at(80)), ("w", 99.0, at(81))]
    stream = files(spark, str(tmp_path / "c"), rows, schema, 1)
    got = st.run_to_table(st.slow_sessions(keyed.with_closing(stream, "ts", spark.createDataFrame(rows, schema), "3 hours"), "ts", ["kind"], "seconds", 40.0), "s")
    assert sorted(map(tuple, got.collect())) == [("v", at(0), at(50), 2, 60.0), ("v", at(80), at(110), 1, 70.0), ("w", at(81), at(111), 1, 99.0)]
