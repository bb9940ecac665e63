"""Readers, writers, user functions and streams on small files."""

import json
import struct

from pyspark.sql import functions as F

from folioflow.operators import aggregates as ag, enrich as en, joins
from folioflow.operators.ledger import retry_cycles
from folioflow.sources import assets, documents, sinks
from folioflow.streaming import streams as st


def _png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h)


def test_assets(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for name in ("0001.png", "page_0003.jpg", "187-05.PNG", "cover.png", "2.txt"):
        (deep / name).write_bytes(_png(30, 40))
    (tmp_path / "a" / "9.webp").write_bytes(b"x")
    files = assets.list_assets(spark, str(tmp_path), content=True)
    found = assets.numbered_assets(files)
    assert sorted(r["number"] for r in found.collect()) == [1, 3, 5, 9]
    root = assets.pick_asset_root(found).first()
    assert root["dir"].endswith("/a/b") and root["n"] == 3
    sizes = {(r["w"], r["h"]) for r in assets.png_size(found.where("number = 1")).collect()}
    assert sizes == {(30, 40)}


def test_page_records(spark, tmp_path):
    page = {"page": 1, "file": "0001.png", "summary": "s", "notes": "", "panels": [
        {"no": 1, "key": "p001_01", "bbox": [0, 0, 1, 1], "shape": "full", "crop": "", "detail": {"characters": [{"name": "A"}]}}]}
    (tmp_path / "page_01.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "page_02.json").write_text("{broken")
    rows = documents.read_page_records(spark, str(tmp_path)).collect()
    assert sorted(r["page"] or 0 for r in rows) == [0, 1] and sum(r["_corrupt"] is not None for r in rows) == 1


def test_section_docs_logs_and_ledger(spark, tmp_path):
    (tmp_path / "docs").mkdir(), (tmp_path / "logs").mkdir(), (tmp_path / "runs").mkdir()
    (tmp_path / "docs" / "p001_02.md").write_text("## A\nx\ny")
    (tmp_path / "docs" / "readme.md").write_text("no")
    rows = documents.read_section_docs(spark, str(tmp_path / "docs"), r"^(p\d{3}_\d{2})\.md$").collect()
    assert [(r["doc"], r["text"]) for r in rows] == [("p001_02", "## A\nx\ny")]
    (tmp_path / "logs" / "s2.log").write_text(
        "2026-09-28 12:00:00,123 [INFO] s2 L3 p001_02: llm ok in 106.0s\n2026-09-28 12:00:01,000 [WARNING] s2 x: attempt 1 failed: y\nnoise\n")
    log, rest = documents.read_stage_logs(spark, str(tmp_path / "logs"))
    assert [r["line"] for r in rest.collect()] == ["noise"]
    got = ag.call_accounting(log, ["stage"]).first()
    assert (got["stage"], got["ok_calls"], got["failed_attempts"], got["mean_ok_seconds"]) == ("s2", 1, 1, 106.0)
    run = {"id": "r1", "stages": {"s0": {"status": "completed", "note": "n", "items": {"a": {"status": "failed", "data": {"x": 1}}}}, "s1": {"status": "pending"}}}
    (tmp_path / "runs" / "project.json").write_text(json.dumps(run))
    rows = {(r["stage"], r["item"], r["status"], r["data"]) for r in documents.read_ledger(spark, str(tmp_path / "runs"))[0].collect()}
    assert rows == {("s0", None, "completed", None), ("s0", "a", "failed", '{"x":1}'), ("s1", None, "pending", None)}


def test_idempotent_write_and_report(spark, tmp_path):
    out = str(tmp_path / "out")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, v int")
    sinks.write_idempotent(d, out, ["unit"])
    sinks.write_idempotent(d.where("unit = 'b'").withColumn("v", F.lit(3)), out, ["unit"])
    assert sorted((r["unit"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]
    units = spark.createDataFrame([("a", 0, 0, 0), ("b", 2, 0, 1), ("c", 1, 1, 2)], "u string, i int, f int, r int")
    totals = sinks.write_report(units, str(tmp_path / "report"), "u", "i", "f", "r")
    assert {r["verdict"]: r["n"] for r in totals.collect()} == {"pass": 1, "repaired": 1, "unresolved": 1}
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["- a: PASS", "- b: REPAIRED (1)", "- c: UNRESOLVED"]


def test_resume_and_cycles(spark):
    todo = spark.createDataFrame([(i,) for i in range(4)], "u int")
    ledger = spark.createDataFrame([(0, "completed"), (1, "completed"), (2, "failed")], "u int, status string")
    outputs = spark.createDataFrame([(0,), (2,)], "u int")
    assert sorted(r["u"] for r in joins.resume(todo, ledger, outputs, ["u"]).collect()) == [1, 2, 3]

    def run(units, cycle):
        ok = F.col("u") < cycle * 2
        return units.select("u", F.when(ok, "completed").otherwise("failed").alias("status"), ok.alias("ok"))

    results, cycles = retry_cycles(todo, ["u"], run)
    assert cycles == 2 and results.count() == 6


def test_json_value(spark):
    raws = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'see {bad} and {"a": 3} end', "nothing", None]
    d = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    good, bad = documents.json_value(d, "raw", "a INT")
    assert {r["i"]: r["record"]["a"] for r in good.collect()} == {0: 1, 1: 2, 2: 3}
    assert sorted(r["i"] for r in bad.collect()) == [3, 4]


def test_enrich_retries_with_errors(spark):
    d = spark.range(10).select(F.col("id").alias("i"))

    def call(rows, errors):
        return (rows["i"].where(errors != "", -1) if len(rows) else rows["i"]).astype(object).to_frame("o")

    def validate(out):
        return out["o"].map(lambda v: [] if v >= 0 else ["negative"])

    good, bad = en.enrich(d, call, "o long", validate, lanes=2)
    assert good.where("attempts = 2 AND o = i").count() == 10 and bad.count() == 0


def _stream(spark, tmp_path, rows, schema, name):
    folder = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, lambda: st.stream_units(spark, folder, spark.read.parquet(folder).schema)


def test_retry_machine_equals_batch(spark, tmp_path):
    rows = [("a", 0, False, 9, False), ("a", 1, True, 8, False), ("b", 0, True, 3, False), ("b", 1, True, 3, False), ("b", 2, True, 3, False), ("c", 0, True, 9, True),
            ("d", 0, False, 0, True), ("d", 1, True, 9, False), ("e", 0, False, 1, False), ("e", 1, False, 1, False), ("e", 2, False, 1, False), ("e", 3, False, 0, True),
            ("f", 0, False, 1, False), ("f", 1, False, 0, True), ("f", 2, True, 9, False), ("g", 0, True, 9, False), ("g", 1, False, 0, True)]
    schema = "unit string, attempt int, passed boolean, points int, infra boolean"
    folder, stream = _stream(spark, tmp_path, rows, schema, "verdicts")
    out = st.run_to_table(st.retry_machine(stream(), "unit", "attempt", "passed", "points", "infra"), "t")
    last = {r["unit"]: r["a"] for r in out.where("action <> 'retry'").groupBy("unit").agg(F.max("action").alias("a")).collect()}
    batch = ag.final_attempt(spark.createDataFrame(rows, schema).withColumn("points", F.col("points").cast("string")), ["unit"], "attempt", "passed", "points", "infra")
    assert last == {r["unit"]: r["status"] for r in batch.collect()} == {
        "a": "completed", "b": "needs_review", "c": "failed", "d": "failed", "e": "needs_review", "f": "failed", "g": "completed"}
