"""The whole stages on the shared tables."""

from pyspark.sql import functions as F

from . import jobs
from .aggregate_queries import attempts_of_events
from .assembly_queries import entity_dim, mentions
from .interval_queries import _required
from .join_queries import stage_ledger
from .registry import all_sql, query
from .rule_queries import _VIDEO_ERRORS, video_prompts
from .section_queries import _H, _heading_errors_sql
from .shape_queries import _BOXES_SQL, _clamped, _details
from .source_queries import _ASSETS_SQL, _asset_paths
from .views import PANEL_ORDER, STATES_SQL, entity_states, panel_blocks, scripts

_SQL = all_sql()


@query("job_ingest", f"""WITH {_ASSETS_SQL}, d AS (SELECT dir FROM (SELECT dir, count(*) AS n, length(dir) - length(replace(dir, '/', '')) AS depth FROM assets GROUP BY 1) ORDER BY depth DESC, n DESC, dir LIMIT 1)
SELECT number, max(file) AS file, arg_max(path, file) AS path, count(*) - 1 AS replaced FROM assets WHERE dir IN (SELECT dir FROM d) GROUP BY 1""")
def job_ingest(t):
    return jobs.ingest(_asset_paths(t))["manifest"]


@query("job_understand", """
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 9 <> 8),
p AS (SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 3 THEN 1 ELSE i END AS INT) AS no, (length(s) % 7) / 10 AS x, (length(s) % 11) / 10 AS y, (length(s) % 5 + 1) / 10 AS w, (length(s) % 3 + 1) / 10 AS h FROM ln),
bad AS (SELECT doc_id FROM p GROUP BY doc_id, no HAVING count(*) > 1 UNION SELECT doc_id FROM p WHERE y > 1 UNION SELECT doc_id FROM documents WHERE doc_id % 20 = 0),
e AS (SELECT *, greatest(0.0, x - 0.03) AS x0, greatest(0.0, y - 0.03) AS y0 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
k AS (SELECT *, CAST(round_even(x0 * 800, 0) AS INT) AS l0, CAST(round_even(y0 * 1200, 0) AS INT) AS t0, least(1.0, x0 + w + 0.06) AS x1, least(1.0, y0 + h + 0.06) AS y1 FROM e)
SELECT printf('p%03d_%02d', doc_id, no) AS key, l0 AS "left", t0 AS top, greatest(l0 + 1, least(800, CAST(round_even(x1 * 800, 0) AS INT))) AS "right",
  greatest(t0 + 1, least(1200, CAST(round_even(y1 * 1200, 0) AS INT))) AS bottom FROM k""")
def job_understand(t):
    doc = F.col("doc_id")
    n = lambda s: F.length(s)
    panels = F.transform(F.split("text", "\n"), lambda s, i: F.struct(
        F.when(doc % 10 == 3, 1).otherwise(i + 1).alias("no"),
        F.array(n(s) % 7 / 10, n(s) % 11 / 10, (n(s) % 5 + 1) / 10, (n(s) % 3 + 1) / 10).alias("bbox"), F.lit("square").alias("shape")))
    body = F.to_json(F.struct(F.when(doc % 20 == 0, "").otherwise(F.col("source")).alias("summary"), panels.alias("panels")))
    raw = F.when(doc % 9 == 8, "sorry").when(doc % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    d = t.documents.select("doc_id", raw.alias("raw"), F.lit(800).alias("pw"), F.lit(1200).alias("ph"))
    return jobs.understand(d, "raw", "doc_id", "pw", "ph")["panels"].select("key", "left", "top", "right", "bottom")


@query("job_scripts", _heading_errors_sql("instr(text, h)", False).split("SELECT doc_id, substr(errs, 2)")[0] + f""",
{STATES_SQL}
SELECT 'entities' AS part, count(DISTINCT l_partkey) AS n FROM lineitem
UNION ALL SELECT 'states accepted', count(*) FILTER (accepted) FROM ({_SQL["repair_states"]})
UNION ALL SELECT 'scripts repaired', count(*) FILTER (errs <> '') FROM w WHERE n = {len(_H)}
UNION ALL SELECT 'issues', count(*) FROM documents WHERE trim(substr(source, 1, 2)) <> '' AND NOT contains(text, source || '!')""")
def job_scripts(t):
    need = t.documents.select("doc_id", F.concat("source", F.lit("!")).alias("w"))
    d = t.lineitem.withColumnRenamed("l_partkey", "entity")
    out = jobs.settings_and_scripts(
        d, "entity", ["l_orderkey", "l_linenumber"], ["l_suppkey"], entity_states(t), _required(t), "pos", 1, 60,
        scripts(t).select("doc_id", "text"), "doc_id", "text", {}, need, "w")
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return (n(out["entities"], "entities").unionByName(n(out["states"].where("accepted"), "states accepted"))
            .unionByName(n(out["scripts"].where("initial > 0 AND final = 0"), "scripts repaired")).unionByName(n(out["issues"], "issues")))


@query("job_prompts", f"WITH a AS ({_SQL['assemble_prompts']}) SELECT size_bucket, count(*) AS prompts, CAST(sum(length(positive)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS missing FROM a GROUP BY 1")
def job_prompts(t):
    panels = t.orders.select(F.col("o_orderkey").alias("panel"), F.concat("o_orderpriority", F.lit(", ")).alias("scene"), F.lit("").alias("tail"), F.lit("lowres").alias("negative"),
                             (600 + F.col("o_custkey") % 900).alias("crop_w"), F.lit(1000).alias("crop_h"))
    st = entity_states(t).withColumn("state_tags", F.concat(F.lit("coat "), F.col("lo").cast("string")))
    out = jobs.prompts(panels, mentions(t), entity_dim(t), st, "panel", "entity", "page", PANEL_ORDER, "run1", panel_blocks())
    made = out["prompts"].join(out["missing"].groupBy("panel").agg(F.count(F.lit(1)).alias("m")), "panel", "left")
    return made.groupBy("size_bucket").agg(F.count(F.lit(1)).alias("prompts"), F.sum(F.length("positive")).alias("chars"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing"))


@query("job_attempts", _SQL["attempt_qc"])
def job_attempts(t):
    plan = t.documents.select("doc_id", F.col("doc_id").alias("seed"))
    return jobs.attempts(plan, "seed", attempts_of_events(t), ["unit"])["health"]


@query("job_typesetting", f"""
WITH f AS ({_SQL["flatten_lines"]}), c AS (SELECT conv_id, count(*) AS n FROM f GROUP BY 1),
pl AS (SELECT conv_id, count(*) AS n, bool_and(turn < 9) AS good FROM f WHERE conv_id % 2 = 0 GROUP BY 1),
fb AS (SELECT f.*, length(text) % 200 + 50 AS bw, length(text) % 90 + 20 AS bh FROM f WHERE conv_id NOT IN (SELECT c.conv_id FROM c JOIN pl ON pl.conv_id = c.conv_id AND pl.n = c.n AND good)),
e AS (SELECT *, coalesce(sum(bh + 28) OVER (PARTITION BY conv_id, kind ORDER BY turn, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM fb)
SELECT conv_id, turn, idx, kind, CASE WHEN kind = 'bubble' THEN 1024 - bw - 30 ELSE 30 END / 1024 AS x, CASE WHEN kind = 'sfx' THEN 1408 - bh - 30 ELSE 30 + above END / 1408 AS y FROM e""")
def job_typesetting(t):
    from ..operators import shape
    det = _details(t)
    lines = shape.flatten_lines(shape.coerce_detail(det), ["conv_id", "turn"], "dialogue", "onomatopoeia")
    places = lines.where("conv_id % 2 = 0").select(
        "conv_id", F.lit(0.1).alias("x"), F.when(F.col("turn") < 9, 0.1).otherwise(1.5).alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))

    def sizes(d):
        n = F.length("text")
        return d.withColumns({"bw": n % 200 + 50, "bh": n % 90 + 20, "pw": F.lit(1024), "ph": F.lit(1408)})

    out = jobs.typesetting(det, ["conv_id", "turn"], sizes, places, "conv_id")["layout"]
    return out.select("conv_id", "turn", "idx", "kind", "x", "y")


@query("job_segments", """
SELECT o_custkey AS k, (r - 1) // 3 + 1 AS seg, count(*) AS n_units, CAST(0 AS BIGINT) AS part_from, count(*) AS part_units, CAST(count(*) * 5 AS DOUBLE) AS part_seconds, 0::BIGINT AS errors
FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1, 2""")
def job_segments(t):
    units = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("unit"))
    out = jobs.segments(units, ["k"], "unit", ["unit"])
    errs = out["errors"].groupBy("k").agg(F.count(F.lit(1)).alias("errors"))
    d = out["segments"].join(errs, "k", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return d.select("k", "seg", "n_units", "part_from", "part_units", "part_seconds", "errors")


@query("job_video_prompts", f"""SELECT CASE WHEN pic THEN 'i2va' ELSE 't2va' END AS mode, count(*) FILTER ({_VIDEO_ERRORS} = '') AS passed,
  count(*) FILTER ({_VIDEO_ERRORS} <> '' AND m NOT IN (6, 12)) AS repaired, count(*) FILTER (m IN (6, 12)) AS unresolved
FROM (SELECT doc_id, doc_id % 13 AS m, doc_id % 2 = 0 AS pic FROM documents) GROUP BY 1""")
def job_video_prompts(t):
    return jobs.video_prompts(video_prompts(t))["rollup"]


@query("job_render", """
SELECT printf('seg_%02d', o_orderkey) AS seg_key, CASE WHEN pic THEN 'i2va' ELSE 't2va' END AS mode, least(o_totalprice / 20000, 15.0) AS duration, CASE WHEN pic THEN 'f.png' END AS image
FROM (SELECT *, o_orderpriority < '4' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AS pic FROM orders)""")
def job_render(t):
    segs = t.orders.select(F.col("o_orderkey").alias("seg"), (F.col("o_totalprice") / 20000).alias("duration"), F.lit("x/f.png").alias("first_frame"),
                           F.when(F.col("o_orderpriority") < "4", "2d").otherwise("3d").alias("style"))
    frames = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("seg"))
    return jobs.render(segs, frames, "seg", frames, "run1")["jobs"].select("seg_key", "mode", "duration", "image")


@query("job_timeline", """
SELECT l_orderkey, clips, total, max_q AS _actual, max_q - total AS "off", abs(max_q - total) > 0.5 AS warn FROM (
  SELECT l_orderkey, count(*) AS clips, max(l_quantity) AS max_q, CAST(sum(CAST(l_quantity + 0.25 AS DECIMAL(18,3))) - (count(*) - 1) * CAST(0.45 AS DECIMAL(10,3)) AS DOUBLE) AS total FROM lineitem GROUP BY 1)""")
def job_timeline(t):
    c, p = F.col, F.lit
    log = F.concat(p("Duration: 00:00:"), F.lpad(c("l_quantity").cast("int").cast("string"), 2, "0"), p(".25, Video: h264, 1280x720, 24 fps Audio: aac, 48000 Hz, stereo"))
    clips = t.lineitem.select("l_orderkey", *PANEL_ORDER, log.alias("log"), c("l_quantity").alias("q"))
    return jobs.timeline(clips, ["l_orderkey"], PANEL_ORDER, "log", "q", panel_blocks())["length"]


@query("job_page_layout", f"""WITH {_BOXES_SQL},
pg AS (SELECT o_orderkey AS page, 600 + o_orderkey % 400 AS pw, 900 + o_custkey % 300 AS ph FROM orders),
p AS (SELECT l_orderkey AS page, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS panel, x, y, w, h, l_partkey FROM cl)
SELECT page, panel, CAST(round_even(x * pw, 0) AS INT) AS "left", CAST(round_even(y * ph, 0) AS INT) AS top, CAST(round_even(w * pw, 0) AS INT) AS width, CAST(round_even(h * ph, 0) AS INT) AS height,
  CASE WHEN l_partkey % 5 = 0 THEN 'set/' ELSE 'pure/' END || panel AS image, l_partkey % 5 = 0 AS is_variant FROM p JOIN pg USING (page)""")
def job_page_layout(t):
    c = F.col
    panel = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = _clamped(t).select(c("l_orderkey").alias("page"), panel.alias("panel"), "x", "y", "w", "h", F.concat(F.lit("pure/"), panel).alias("image"))
    pages = t.orders.select(c("o_orderkey").alias("page"), (600 + c("o_orderkey") % 400).alias("page_w"), (900 + c("o_custkey") % 300).alias("page_h"))
    v = t.lineitem.where("l_partkey % 5 = 0").select(panel.alias("panel")).distinct().withColumn("image", F.concat(F.lit("set/"), "panel"))
    return jobs.page_layout(p, pages, "page", v, "panel").select("page", "panel", "left", "top", "width", "height", "image", "is_variant")


@query("job_run_status", f"""WITH s AS ({_SQL["stage_strip"]}), n AS ({_SQL["next_pending"]}), r AS ({_SQL["ready_stages"]}), k AS ({_SQL["skip_cascade"]})
SELECT s.run, s.strip, n.next_stage, (SELECT count(*) FROM r WHERE r.run = s.run) AS n_ready, (SELECT count(*) FROM k WHERE k.run = s.run) AS n_skipped FROM s JOIN n ON n.run = s.run""")
def job_run_status(t):
    return jobs.run_status(stage_ledger(t), "run")
