"""Queries on rule checks and repair."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import aggregates as ag, repair, rules, sections as sc
from ..operators.shape import rule_errors
from .registry import query
from .section_queries import _H, _heading_errors_sql
from .shape_queries import _BOXES_SQL, _boxes
from .views import SCRIPTS_SQL, scripts


@query("check_layout", f"""
WITH {_BOXES_SQL}, pn AS (SELECT l_orderkey AS page, CAST(l_linenumber AS INT) - CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS no, x, y, w, h, CASE WHEN l_suppkey % 20 = 0 THEN 'oval' ELSE shape END AS shape FROM bx),
pg AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS page, CASE WHEN o_orderkey % 40 = 0 THEN ' ' ELSE o_orderpriority END AS summary FROM orders)
SELECT page, no, 'no' AS rule FROM pn WHERE no < 1
UNION ALL SELECT page, no, 'box origin' FROM pn WHERE NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1)
UNION ALL SELECT page, no, 'box size' FROM pn WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND (w <= 0 OR h <= 0)
UNION ALL SELECT page, no, 'shape' FROM pn WHERE shape NOT IN ('vertical', 'horizontal', 'square', 'full')
UNION ALL SELECT page, NULL, 'summary' FROM pg WHERE trim(summary) = ''
UNION ALL SELECT page, NULL, 'no panels' FROM pg WHERE page NOT IN (SELECT page FROM pn)
UNION ALL SELECT page, no, 'no repeated' FROM pn WHERE no >= 1 GROUP BY page, no HAVING count(*) > 1""")
def check_layout(t):
    panels = _boxes(t).select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)).alias("no"), "x", "y", "w", "h",
        F.when(F.col("l_suppkey") % 20 == 0, "oval").otherwise(F.col("shape")).alias("shape"))
    pages = t.orders.select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("page"), F.when(F.col("o_orderkey") % 40 == 0, " ").otherwise(F.col("o_orderpriority")).alias("summary"))
    return rules.check_layout(pages, panels, "page", "no", "x", "y", "w", "h", "shape", "summary")


_DETAILS = [  # fixed values: one good record and seven broken ones
    '{"characters": [{"name": "@"}], "dialogue": [{"text": "@"}], "onomatopoeia": [], "action": "", "setting": "", "camera": "", "clothing_notes": ""}',
    '{"characters": [{"name": "@"}], "dialogue": [], "onomatopoeia": [], "action": "", "setting": "", "camera": ""}',
    '{"characters": "@", "dialogue": [], "onomatopoeia": [], "action": 3, "setting": "", "camera": "", "clothing_notes": ""}',
    '{"characters": [{"nom": "@"}], "dialogue": [{"text": 5}], "onomatopoeia": [], "action": "", "setting": "", "camera": "", "clothing_notes": ""}',
    '["@"]',
    'not json @',
    '{"characters": [], "dialogue": ["@"], "onomatopoeia": "boom", "action": "", "setting": "", "camera": "", "clothing_notes": ""}',
    '{"dialogue": []}',
]
_DETAIL_ERRORS = [
    "", "missing clothing_notes", "characters not a list|action not a text", "characters item|dialogue item", "not an object", "not an object",
    "onomatopoeia not a list|dialogue item", "missing characters|missing onomatopoeia|missing action|missing setting|missing camera|missing clothing_notes",
]


@query("check_detail", "SELECT conv_id, turn, ([" + ", ".join(f"'{e}'" for e in _DETAIL_ERRORS) + "])[(conv_id * 3 + turn) % 8 + 1] AS errors FROM conversations")
def check_detail(t):
    raw = F.element_at(F.array(*[F.lit(d) for d in _DETAILS]), ((F.col("conv_id") * 3 + F.col("turn")) % 8 + 1).cast("int"))
    d = t.conversations.select("conv_id", "turn", F.replace(raw, F.lit("@"), F.col("role")).alias("raw"))
    return d.select("conv_id", "turn", F.array_join(rules.detail_errors(F.col("raw")), "|").alias("errors"))


@query("check_entities", """
WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 30 = 0 THEN '' ELSE p_name || ' ' || p_partkey // 2 END AS name, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE 'a' END AS al,
  CASE p_type WHEN 'ECONOMY' THEN 'Female' WHEN 'SMALL' THEN 'male ' ELSE 'unknown' END AS g, CASE WHEN p_size < 5 THEN 'abc' ELSE p_brand END AS ap,
  CASE WHEN p_partkey % 23 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN p_name ELSE '1Girl, ' || p_name END AS tg, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_brand END AS an, p_type AS ao FROM part),
s AS (SELECT CASE WHEN l_partkey % 37 = 0 THEN -l_partkey ELSE l_partkey END AS k, CASE WHEN l_quantity > 49 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS pages, CASE WHEN l_tax > 0.07 AND l_quantity > 45 THEN '' ELSE l_returnflag END AS st FROM lineitem)
SELECT k, 'name' AS rule FROM e WHERE name = '' UNION ALL SELECT k, 'aliases' FROM e WHERE al IS NULL
UNION ALL SELECT k, 'gender' FROM e WHERE g = 'unknown' UNION ALL SELECT k, 'appearance' FROM e WHERE length(ap) < 5
UNION ALL SELECT k, 'tags' FROM e WHERE trim(tg) = '' UNION ALL SELECT k, 'first tag' FROM e WHERE trim(tg) <> '' AND NOT starts_with(tg, '1Girl')
UNION ALL SELECT k, 'anchor name' FROM e WHERE an = ''
UNION ALL SELECT k, 'name repeated' FROM e WHERE name <> '' AND name IN (SELECT name FROM e GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT k, 'no states' FROM e WHERE k NOT IN (SELECT k FROM s)
UNION ALL SELECT DISTINCT k, 'state pages' FROM s WHERE pages = 'x' UNION ALL SELECT DISTINCT k, 'state text' FROM s WHERE st = ''""")
def check_entities(t):
    c = F.col
    k = c("p_partkey")
    e = t.part.select(
        k.alias("k"), F.when(k % 30 == 0, "").otherwise(F.concat("p_name", F.lit(" "), F.floor(k / 2).cast("string"))).alias("name"),
        F.when(k % 31 != 0, F.array(F.lit("a"))).alias("aliases"),
        F.when(c("p_type") == "ECONOMY", "Female").when(c("p_type") == "SMALL", "male ").otherwise("unknown").alias("gender"),
        F.when(c("p_size") < 5, "abc").otherwise(c("p_brand")).alias("appearance"),
        F.when(k % 23 == 0, " ").when(k % 3 == 0, c("p_name")).otherwise(F.concat(F.lit("1Girl, "), "p_name")).alias("tags"),
        F.when(k % 19 == 0, "").otherwise(c("p_brand")).alias("anchor_name"), c("p_type").alias("anchor_origin"))
    s = t.lineitem.select(
        F.when(c("l_partkey") % 37 == 0, -c("l_partkey")).otherwise(c("l_partkey")).alias("k"), F.when(c("l_quantity") > 49, "x").otherwise(c("l_quantity").cast("int").cast("string")).alias("pages"),
        F.when((c("l_tax") > 0.07) & (c("l_quantity") > 45), "").otherwise(c("l_returnflag")).alias("state_text"))
    return rules.check_entities(e, s, "k")


@query("check_issue_rows", """
SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 5 = 0 THEN 'file blank' END, CASE WHEN doc_id % 7 = 0 THEN 'fix blank' END) AS errors FROM documents""")
def check_issue_rows(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("source")).alias("file"), F.col("lang").alias("problem"),
                           F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("fix"))
    good, bad = rules.check_issue_rows(d)
    return good.select("doc_id", F.lit("").alias("errors")).unionByName(bad.select("doc_id", F.array_join("errors", "|").alias("errors")))


@query("check_placements", f"""WITH {_BOXES_SQL}, p AS (SELECT l_orderkey AS panel, count(*) AS n, bool_and(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1 AND x + w <= 1.01 AND y + h <= 1.01) AS good
  FROM (SELECT l_orderkey, greatest(x, 0.0) / 2 AS x, greatest(y, 0.0) / 2 AS y, w / 2 AS w, h / 2 AS h FROM bx) GROUP BY 1)
SELECT o_orderkey AS panel, o_custkey % 5 + 1 AS n_lines, CASE WHEN coalesce(good AND n = o_custkey % 5 + 1, false) THEN 'model' ELSE 'fallback' END AS layout FROM orders LEFT JOIN p ON panel = o_orderkey""")
def check_placements(t):
    pl = _boxes(t).select(F.col("l_orderkey").alias("panel"), (F.greatest("x", F.lit(0.0)) / 2).alias("x"), (F.greatest("y", F.lit(0.0)) / 2).alias("y"), (F.col("w") / 2).alias("w"), (F.col("h") / 2).alias("h"))
    exp = t.orders.select(F.col("o_orderkey").alias("panel"), (F.col("o_custkey") % 5 + 1).alias("n_lines"))
    return rules.check_placements(pl, exp, "panel", "n_lines", "x", "y", "w", "h")


@query("check_segments", """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS pos, o_totalprice / 30000 AS d, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS beat,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
u AS (SELECT o_custkey AS k, o_orderkey AS unit FROM orders), us AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN -o_orderkey ELSE o_orderkey END AS unit FROM orders UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 29 = 0)
SELECT k, CAST(seg AS VARCHAR) AS item, 'seg number' AS rule FROM s WHERE seg <> place
UNION ALL SELECT k, CAST(seg AS VARCHAR), 'duration' FROM s WHERE NOT (d BETWEEN 1.0 AND 15.0)
UNION ALL SELECT k, CAST(seg AS VARCHAR), 'beat' FROM s WHERE trim(beat) = ''
UNION ALL SELECT k, CAST(unit AS VARCHAR), 'missing' FROM u WHERE unit NOT IN (SELECT unit FROM us)
UNION ALL SELECT k, CAST(unit AS VARCHAR), 'unknown' FROM us WHERE unit NOT IN (SELECT unit FROM u)
UNION ALL SELECT k, CAST(unit AS VARCHAR), 'duplicate' FROM us GROUP BY k, unit HAVING count(*) > 1""")
def check_segments(t):
    from ..operators.scan import numbered
    c = F.col
    o = t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("unit"), (c("o_totalprice") / 30000).alias("d"), F.when(c("o_orderkey") % 17 == 0, " ").otherwise(c("o_orderpriority")).alias("beat"))
    segs = numbered(o, ["k"], ["unit"], "seg").withColumn("seg", c("seg") + F.when(c("unit") % 19 == 0, 1).otherwise(0))
    used = o.select("k", F.when(c("unit") % 23 == 0, -c("unit")).otherwise(c("unit")).alias("unit")).unionByName(o.where("unit % 29 = 0").select("k", "unit"))
    return rules.check_segments(segs, used, o.select("k", "unit"), ["k"], seg="seg", place=["unit"], duration="d", beat="beat", unit="unit", order=["unit"], unit_order=["unit"])


def _seg_scripts(t):
    """Segment scripts written around the documents, with one kind of fault per residue."""
    c, h = F.col, fixed.SEGMENT_HEADINGS
    m = c("doc_id") % 6
    second = F.when(m == 1, "2.5").otherwise("2")
    design = F.concat(F.when(m == 2, F.lit("- 1-2s a")).otherwise(F.lit("- 0-2s a")), F.lit("\nplain\n**"), second, F.lit("–"), F.when(m == 3, "3").otherwise("7"), F.lit("s b"))
    heads = [F.lit(x) for x in h]
    text = F.concat(heads[0], F.lit("\n"), F.substring("text", 1, 50), F.lit("\n"), heads[1], F.lit("\n"), F.when(m == 4, F.lit("none")).otherwise(design), F.lit("\n"),
                    *[F.concat(x, F.lit("\n")) for x in heads[2:6]], F.when(m == 5, F.lit("")).otherwise(heads[6]))
    return t.documents.select("doc_id", text.alias("text"), F.lit(7.9).alias("duration"), F.array(F.substring("text", 3, 10), "source").alias("dialogue"))


@query("check_segment_script", f"""
SELECT doc_id, concat_ws('|', CASE WHEN m = 5 THEN 'missing {fixed.SEGMENT_HEADINGS[6]}' END, CASE WHEN m = 4 THEN 'no seconds' END, CASE WHEN m = 2 THEN 'not from 0' END,
  CASE WHEN m = 1 THEN 'gap' END, CASE WHEN m = 3 THEN 'too short' END, 'not verbatim: ' || source) AS errors FROM (SELECT *, doc_id % 6 AS m FROM documents)""")
def check_segment_script(t):
    return _seg_scripts(t).select("doc_id", F.array_join(rules.segment_script_errors(F.col("text"), F.col("duration"), F.col("dialogue")), "|").alias("errors"))


def video_prompts(t):
    """Two-shot prompts around the documents; residue 0 is clean, the others break one rule each."""
    c = F.col
    m, p = c("doc_id") % 13, F.lit
    pictured = c("doc_id") % 2 == 0
    first = F.when(m == 1, fixed.I2VA_FIRST_LINE[:-1]).otherwise(fixed.I2VA_FIRST_LINE)
    head = F.when(pictured, F.concat(first, F.when(m == 2, "\nx\n").otherwise("\n\n"))).otherwise(F.when(m == 3, fixed.I2VA_FIRST_LINE + "\n").otherwise(""))
    shot2 = F.when(m == 4, "[Shot 2] At 00:09.000,").when(m == 5, "[Shot 2] then").when(m == 6, "[Shot 3] At 00:04.000,").otherwise("[Shot 2] At 00:04.000,")
    lock = F.when(m == 7, "(identity lock)").otherwise(f"({fixed.LOCK_PHRASE})")
    said = F.concat(p("<d>[Chinese] "), F.when(m == 8, "gone").otherwise(c("lang")), p(" of the day "), F.when(m == 9, "").otherwise("</d>"))
    name = F.when(m == 10, "nobody").otherwise(c("source"))
    desc = F.concat(p(fixed.PROMPT_FIELDS[0] + " [Shot 1]"), F.when(m == 11, " At 00:01.000,").otherwise(""), p(" "), lock, p(" "), name, p(" says "), said, p(" "), shot2, p(" "), F.substring("text", 1, 60))
    sound, music = p("\n\n" + fixed.PROMPT_FIELDS[1] + " wind"), p("\n\n" + fixed.PROMPT_FIELDS[2] + " drums")
    tail = F.when(m == 12, F.concat(music, sound)).otherwise(F.concat(sound, music))
    return t.documents.select(
        "doc_id", F.concat(head, desc, tail).alias("prompt"), F.when(pictured, "i2va").otherwise("t2va").alias("mode"), F.lit(8.5).alias("duration"),
        F.array(F.concat("lang", p(" of the day"))).alias("dialogue"), F.array("source").alias("names"))


_VIDEO_ERRORS = """CASE m WHEN 1 THEN CASE WHEN pic THEN 'first line' ELSE '' END WHEN 2 THEN CASE WHEN pic THEN 'second line not blank' ELSE '' END
  WHEN 3 THEN CASE WHEN pic THEN '' ELSE 'first line not allowed|start field' END WHEN 4 THEN 'time out of range' WHEN 5 THEN 'timed shots incomplete'
  WHEN 6 THEN 'shot numbers not contiguous|timed shots incomplete' WHEN 7 THEN 'lock phrase' WHEN 8 THEN 'dialogue not verbatim' WHEN 9 THEN 'tags unbalanced'
  WHEN 10 THEN 'name missing' WHEN 11 THEN 'shot 1 has a time|timed shots incomplete' WHEN 12 THEN 'order non_diegetic_music:' ELSE '' END"""


@query("check_prompt", f"SELECT doc_id, {_VIDEO_ERRORS} AS errors FROM (SELECT doc_id, doc_id % 13 AS m, doc_id % 2 = 0 AS pic FROM documents)")
def check_prompt(t):
    d = video_prompts(t)
    return d.select("doc_id", F.array_join(rules.prompt_errors(*[F.col(c) for c in ("prompt", "mode", "duration", "dialogue", "names")]), "|").alias("errors"))


@query("repair_video_prompt", f"SELECT doc_id, {_VIDEO_ERRORS} <> '' AS was_broken, m IN (6, 12) AS still_broken FROM (SELECT doc_id, doc_id % 13 AS m, doc_id % 2 = 0 AS pic FROM documents)")
def repair_video_prompt(t):
    args = ("prompt", "mode", "duration", "dialogue", "names")
    errors = lambda: F.size(rules.prompt_errors(*[F.col(c) for c in args]))
    d = video_prompts(t).withColumn("was_broken", errors() > 0)
    d = repair.repair_video_prompt(d, *args)
    return d.select("doc_id", "was_broken", (errors() > 0).alias("still_broken"))


def prompt_tables(t):
    """Prompts of parts, their cast and the current settings; some rows are out of date."""
    c, p = F.col, F.lit
    k = c("p_partkey")
    tags = F.replace("p_name", p(" "), p(", "))
    positive = (F.when(k % 11 == 0, F.upper(F.split("p_name", " ")[0])).when(k % 13 == 0, F.concat(tags, p(", 银发, "), F.lower("p_type")))
                .when(k % 17 == 0, " , ").otherwise(F.concat(p("("), F.replace("p_name", p(" "), p(":1.1), ")), p(", "), F.lower("p_type"), p(","))))
    prompts = t.part.select(
        k.alias("panel"), positive.alias("positive"), F.when(k % 50 == 0, "低质量").otherwise("lowres").alias("negative"), (c("p_size") * 20).alias("crop_w"), p(500).alias("crop_h"),
        F.when(c("p_size") < 20, "vertical").otherwise("square").alias("size_bucket"), F.when(c("p_size") < 20, 1024).otherwise(1216).alias("width"), F.when(c("p_size") < 20, 1408).otherwise(1216).alias("height"))
    name = F.concat(p("e"), k.cast("string"))
    cast = t.part.select(k.alias("panel"), name.alias("name"), c("p_brand").alias("anchor")).unionByName(
        t.part.where("p_partkey % 100 = 0").select((k + 1).alias("panel"), name.alias("name"), c("p_type").alias("anchor")))
    entities = t.part.where("p_partkey % 200 <> 3").select(name.alias("name"), tags.alias("tags"), F.lower("p_type").alias("state_tags"))
    return prompts, cast, entities


_PROMPT_SET_SQL = """
WITH q AS (SELECT p_partkey AS panel, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS st, p_size * 20 / 500 AS asp, p_size, p_brand, p_type,
  CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 13 = 0 THEN 2 WHEN p_partkey % 17 = 0 THEN 3 ELSE 0 END AS kind FROM part),
bk AS (SELECT *, CASE WHEN asp < 0.8 THEN 'vertical' WHEN asp > 1.25 THEN 'horizontal' ELSE 'square' END AS here FROM q),
cast_ AS (SELECT panel, panel AS ent, p_brand AS anchor FROM q UNION ALL SELECT panel + 1, panel, p_type FROM q WHERE panel % 100 = 0),
ents AS (SELECT panel AS ent, unnest([a, b, st]) AS tok, a, b, st FROM q WHERE panel % 200 <> 3),
have AS (SELECT panel, CASE kind WHEN 1 THEN [a] WHEN 2 THEN [a, b, '银发', st] WHEN 3 THEN [] ELSE [a, b, st] END AS h FROM q),
torn AS (SELECT ent FROM cast_ GROUP BY 1 HAVING count(DISTINCT anchor) > 1)
SELECT panel, 'empty' AS rule, '' AS detail FROM q WHERE kind = 3
UNION ALL SELECT panel, 'bucket', here FROM bk WHERE here <> CASE WHEN p_size < 20 THEN 'vertical' ELSE 'square' END
UNION ALL SELECT panel, 'cjk', '银发' FROM q WHERE kind = 2
UNION ALL SELECT panel, 'warn negative cjk', '' FROM q WHERE panel % 50 = 0
UNION ALL SELECT panel, 'unknown entity', 'e' || ent FROM cast_ WHERE ent NOT IN (SELECT ent FROM ents)
UNION ALL SELECT c.panel, 'tag missing', 'e' || c.ent || ':' || tok FROM cast_ c JOIN ents USING (ent) JOIN have h ON h.panel = c.panel WHERE NOT list_contains(h.h, tok)
UNION ALL SELECT DISTINCT panel, 'anchor differs', 'e' || ent FROM cast_ WHERE ent IN (SELECT ent FROM torn)"""


@query("check_prompts_set", _PROMPT_SET_SQL)
def check_prompts_set(t):
    return rules.check_prompts_set(*prompt_tables(t), "panel")


@query("repair_prompts", """
SELECT p_partkey AS panel, CASE WHEN asp < 0.8 THEN 'vertical' WHEN asp > 1.25 THEN 'horizontal' ELSE 'square' END AS size_bucket,
  CASE WHEN g = '' THEN '2girls' ELSE g END || ', ' || CASE WHEN p_partkey % 200 = 3 THEN 'old, stale' ELSE p_brand || ', ' || replace(p_name, ' ', ', ') || ', ' || lower(p_type) END
  || ', forest,best quality,' AS positive
FROM (SELECT *, p_size * 20 / 500 AS asp, CASE WHEN p_partkey % 200 = 3 THEN '' WHEN p_type IN ('ECONOMY', 'SMALL') THEN '1girl' WHEN p_type = 'LARGE' THEN '1boy' ELSE 'no humans' END AS g FROM part)""")
def repair_prompts(t):
    from ..operators.assembly import repair_prompts as fix
    c, p = F.col, F.lit
    prompts, cast, entities = prompt_tables(t)
    sex = F.when(c("p_type").isin("ECONOMY", "SMALL"), "female").when(c("p_type") == "LARGE", "male").otherwise("-")
    prompts = prompts.withColumns({"scene_tags": p("森林, forest, 夜"), "quality_tail": p("best quality, 高清"), "count_tag": p("2girls")})
    cast = cast.where(F.concat(p("e"), c("panel").cast("string")) == c("name")).select(
        "panel", "name", p("old").alias("anchor"), p("stale").alias("tags"), p("").alias("state_tags"), p("female").alias("gender"), p(1).alias("ord"))
    dims = entities.join(t.part.select(F.concat(p("e"), c("p_partkey").cast("string")).alias("name"), F.concat("p_brand", p(", 红")).alias("anchor"), sex.alias("gender")), "name")
    return fix(prompts, cast, dims, "panel", ["ord"]).select("panel", "size_bucket", "positive")


@query("check_static", f"""WITH {SCRIPTS_SQL}, ex AS (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels),
hd AS (SELECT unnest([{", ".join(f"'{h}'" for h in _H[:3])}]) AS h), rq AS (SELECT doc_id, substr(text, 2, 9) AS w FROM documents UNION ALL SELECT doc_id, source || '!' FROM documents UNION ALL SELECT doc_id, '(note)' FROM documents)
SELECT doc_id, 'document missing' AS problem FROM ex WHERE doc_id NOT IN (SELECT doc_id FROM scripts)
UNION ALL SELECT doc_id, 'missing ' || h FROM scripts JOIN ex USING (doc_id), hd WHERE NOT contains(text, h)
UNION ALL SELECT rq.doc_id, 'not verbatim: ' || {"regexp_replace(w, '^\\s+|\\s+$', '', 'g')"} FROM rq JOIN ex USING (doc_id) JOIN scripts USING (doc_id)
  WHERE w <> '(note)' AND trim(w) <> '' AND NOT contains(text, {"regexp_replace(w, '^\\s+|\\s+$', '', 'g')"})""")
def check_static(t):
    ex = t.labels.select((F.col("doc_id") * 2).alias("doc_id")).distinct()
    d = t.documents
    need = d.select("doc_id", F.explode(F.array(F.substring("text", 2, 9), F.concat("source", F.lit("!")), F.lit("(note)"))).alias("w"))
    return rules.check_static(ex, scripts(t), need, "doc_id", "text", "w", _H[:3])


@query("check_duration", 'SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - l_extendedprice / 2000 AS "off", abs(l_quantity - l_extendedprice / 2000) > 0.5 AS warn FROM lineitem')
def check_duration(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 2000).alias("e"))
    return rules.check_duration(d, "a", "e").drop("a", "e")


@query("repair_loop", _heading_errors_sql("instr(text, h)", False).replace("SELECT doc_id, substr(errs, 2) AS errors FROM w", """
SELECT source, count(*) FILTER (errs = '') AS passed, count(*) FILTER (errs <> '') AS repaired, CAST(0 AS BIGINT) AS unresolved FROM w JOIN documents USING (doc_id)""") + " GROUP BY source")
def repair_loop(t):
    d = repair.repair_loop(
        scripts(t), lambda x: sc.check_headings(x, "text", _H), lambda x: sc.repair_headings(x, "text", _H, {}))
    return ag.check_rollup(d, ["source"], "initial", "final")
