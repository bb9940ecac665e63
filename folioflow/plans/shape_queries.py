"""Queries on record shaping."""

from pyspark.sql import functions as F

from ..operators import shape
from .registry import query

_LINES_SQL = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""


def _page_records(t):
    """Documents as pages, their lines as panels."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.struct(
        (i + 1).cast("int").alias("no"), s.alias("body"), F.length(s).alias("chars")))
    return t.documents.select(F.col("doc_id").alias("page"), lines.alias("panels"))


@query("explode_children", f"""WITH {_LINES_SQL}
SELECT doc_id AS page, CAST(i AS INT) AS no, body, CAST(length(body) AS INT) AS chars, printf('p%03d_%02d', doc_id, i) AS key FROM ln""")
def explode_children(t):
    return shape.explode_children(_page_records(t), "page", "panels")


@query("compact", f"""WITH {_LINES_SQL}
SELECT doc_id AS page, string_agg(i || ':' || length(body), ',' ORDER BY i) AS slim FROM ln GROUP BY 1""")
def compact(t):
    d = shape.compact(_page_records(t), "panels", ["no", "chars"])
    return d.select("page", F.array_join(F.transform("panels", lambda p: F.concat_ws(":", p["no"], p["chars"])), ",").alias("slim"))


def _details(t):
    first = F.split("text", " ")[0]
    return t.conversations.select(
        "conv_id", "turn",
        F.array(F.struct(F.when(F.col("role") != "user", F.col("role")).alias("name"), F.lit(None).cast("string").alias("appearance"))).alias("characters"),
        F.transform(F.split("text", "\n"), lambda s: F.struct(
            F.when(F.col("role") == "system", "旁白").when(F.col("role") == "user", F.col("role")).alias("speaker"), s.alias("text"))).alias("dialogue"),
        F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(first).alias("onomatopoeia"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("action"),
    )


@query("coerce_detail", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN '?' ELSE role END AS name, '' AS appearance,
  CASE role WHEN 'system' THEN '旁白' WHEN 'user' THEN 'user' ELSE '?' END AS speaker,
  CAST(len(string_split(text, chr(10))) AS INT) AS n_lines,
  CASE WHEN turn % 3 = 0 THEN '' ELSE string_split(text, ' ')[1] END AS sounds,
  CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS action
FROM conversations""")
def coerce_detail(t):
    d = shape.coerce_detail(_details(t))
    return d.select(
        "conv_id", "turn", F.col("characters")[0]["name"].alias("name"), F.col("characters")[0]["appearance"].alias("appearance"),
        F.col("dialogue")[0]["speaker"].alias("speaker"), F.size("dialogue").alias("n_lines"),
        F.array_join("onomatopoeia", "|").alias("sounds"), "action",
    )


@query("flatten_lines", r"""
WITH d AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls, string_split(text, ' ')[1] AS w FROM conversations),
a AS (SELECT conv_id, turn, 0 AS part, i, CASE WHEN role = 'system' THEN 'narration' ELSE 'bubble' END AS kind,
        regexp_replace(l, '^\s+|\s+$', '', 'g') AS text,
        CASE role WHEN 'system' THEN '旁白' WHEN 'user' THEN 'user' ELSE '?' END AS speaker
      FROM (SELECT conv_id, turn, role, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d)
      UNION ALL
      SELECT conv_id, turn, 1, 1, 'sfx', regexp_replace(w, '^\s+|\s+$', '', 'g'), '' FROM d WHERE turn % 3 <> 0)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY part, i) - 1 AS INT) AS idx, kind, text, speaker
FROM a WHERE text <> ''""")
def flatten_lines(t):
    return shape.flatten_lines(shape.coerce_detail(_details(t)), ["conv_id", "turn"], "dialogue", "onomatopoeia")


def _boxes(t):
    """Boxes from the measures of a panel; some leave the page on purpose."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_discount") * 12 - 0.1).alias("x"), (F.col("l_tax") * 15 - 0.1).alias("y"),
        (F.col("l_quantity") / 40 - 0.05).alias("w"), (F.col("l_extendedprice") / 100000 - 0.1).alias("h"),
        F.when(F.col("l_returnflag") == "R", "full").otherwise("square").alias("shape"),
    )


_BOXES_SQL = """bx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 12 - 0.1 AS x, l_tax * 15 - 0.1 AS y,
  l_quantity / 40 - 0.05 AS w, l_extendedprice / 100000 - 0.1 AS h, CASE WHEN l_returnflag = 'R' THEN 'full' ELSE 'square' END AS shape FROM lineitem),
cl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, shape, least(greatest(x, 0.0), 1.0) AS x, least(greatest(y, 0.0), 1.0) AS y,
  least(greatest(w, 0.005), 1.0) AS w, least(greatest(h, 0.005), 1.0) AS h FROM bx)"""


def _clamped(t):
    return shape.clamp_boxes(_boxes(t), "x", "y", "w", "h")


@query("clamp_boxes", f"WITH {_BOXES_SQL} SELECT * FROM cl")
def clamp_boxes(t):
    return _clamped(t)


@query("crop_rects", f"""WITH {_BOXES_SQL},
e AS (SELECT *, 600 + CAST(l_partkey % 400 AS INT) AS pw, 900 + CAST(l_suppkey % 300 AS INT) AS ph,
  greatest(0.0, x - 0.03) AS x0, greatest(0.0, y - 0.03) AS y0 FROM cl),
g AS (SELECT *, least(1.0, x0 + w + 0.06) AS x1, least(1.0, y0 + h + 0.06) AS y1 FROM e),
k AS (SELECT *, CAST(round_even(x0 * pw, 0) AS INT) AS l0, CAST(round_even(y0 * ph, 0) AS INT) AS t0 FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, shape, pw, ph,
  CASE WHEN shape = 'full' THEN 0 ELSE l0 END AS "left", CASE WHEN shape = 'full' THEN 0 ELSE t0 END AS top,
  CASE WHEN shape = 'full' THEN pw ELSE greatest(l0 + 1, least(pw, CAST(round_even(x1 * pw, 0) AS INT))) END AS "right",
  CASE WHEN shape = 'full' THEN ph ELSE greatest(t0 + 1, least(ph, CAST(round_even(y1 * ph, 0) AS INT))) END AS bottom FROM k""")
def crop_rects(t):
    d = _clamped(t).withColumns({
        "pw": (F.lit(600) + (F.col("l_partkey") % 400).cast("int")), "ph": (F.lit(900) + (F.col("l_suppkey") % 300).cast("int"))})
    return shape.crop_rects(d, "x", "y", "w", "h", "pw", "ph", "shape").drop("x", "y", "w", "h")


@query("layout_rects", f"""WITH {_BOXES_SQL},
pg AS (SELECT o_orderkey AS l_orderkey, 600 + o_orderkey % 400 AS pw, 900 + o_custkey % 300 AS ph FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(x * pw, 0) AS INT) AS "left",
  CAST(round_even(y * ph, 0) AS INT) AS top, CAST(round_even(w * pw, 0) AS INT) AS width, CAST(round_even(h * ph, 0) AS INT) AS height
FROM cl JOIN pg USING (l_orderkey)""")
def layout_rects(t):
    pages = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), (600 + F.col("o_orderkey") % 400).alias("pw"), (900 + F.col("o_custkey") % 300).alias("ph"))
    d = shape.layout_rects(_clamped(t), pages, ["l_orderkey"], "x", "y", "w", "h", "pw", "ph")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "left", "top", "width", "height")


@query("aspect_bucket", """
SELECT l_orderkey, l_linenumber, pw, bucket,
  CASE bucket WHEN 'vertical' THEN 1024 WHEN 'horizontal' THEN 1408 ELSE 1216 END AS target_w,
  CASE bucket WHEN 'vertical' THEN 1408 WHEN 'horizontal' THEN 1024 ELSE 1216 END AS target_h
FROM (SELECT *, CASE WHEN pw / 500 < 0.8 THEN 'vertical' WHEN pw / 500 > 1.25 THEN 'horizontal' ELSE 'square' END AS bucket
      FROM (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS pw FROM lineitem))""")
def aspect_bucket(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 20).alias("pw"), F.lit(500).alias("ph"))
    return shape.aspect_bucket(d, "pw", "ph").drop("ph")


@query("effective_params", """
SELECT c_custkey, CASE WHEN q IN ('std', 'hd') THEN q ELSE 'std' END AS quality,
  coalesce(CASE WHEN c_custkey % 3 = 0 THEN '16:9' END, c_mktsegment, '4:3') AS aspect, '15' AS max_seconds
FROM (SELECT *, coalesce(CASE WHEN c_acctbal < 0 THEN 'hd' END, CASE WHEN c_nationkey % 2 = 0 THEN 'ultra' END, 'std') AS q FROM customer)""")
def effective_params(t):
    c = t.customer
    opts = F.create_map(F.lit("aspect"), F.when(F.col("c_custkey") % 3 == 0, "16:9"))
    run = F.create_map(F.lit("aspect"), F.col("c_mktsegment"))
    p = shape.effective_params({"aspect": "4:3", "max_seconds": "15"}, run, opts)
    quality = shape.effective_param(
        F.when(F.col("c_acctbal") < 0, "hd"), F.when(F.col("c_nationkey") % 2 == 0, "ultra"), "std", ["std", "hd"])
    return c.select("c_custkey", quality.alias("quality"), p["aspect"].alias("aspect"), p["max_seconds"].alias("max_seconds"))


def segments_of_orders(t):
    with_frame = F.col("o_orderstatus") == "F"
    return t.orders.select(
        F.col("o_orderkey").alias("seg"), (F.col("o_totalprice") / 20000).alias("duration"),
        F.when(with_frame, "i2va").otherwise("t2va").alias("mode"),
        F.when(with_frame, F.concat(F.lit("frames/a/f"), F.col("o_custkey").cast("string"), F.lit(".png"))).alias("first_frame"),
    )


@query("render_jobs", """
SELECT seg_key, mode, least(duration, 15.0) AS duration, CASE WHEN mode = 'i2va' THEN 'f' || o_custkey || '.png' END AS image,
  CASE WHEN mode = 't2va' THEN '16:9 (Widescreen)' END AS aspect_ratio, CAST(0.4 AS DOUBLE) AS megapixels,
  CAST(CAST('0x' || substr(md5('run1:' || seg_key), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS noise_seed, 'run1/' || seg_key AS filename_prefix
FROM (SELECT *, printf('seg_%02d', o_orderkey) AS seg_key, o_totalprice / 20000 AS duration,
        CASE WHEN o_orderstatus = 'F' THEN 'i2va' ELSE 't2va' END AS mode FROM orders)""")
def render_jobs(t):
    return shape.render_jobs(segments_of_orders(t), "run1")


@query("image_jobs", """
SELECT printf('p%03d_%02d', l_orderkey, l_linenumber) AS panel,
  CAST(round_even((1000 + l_partkey % 99) * 1.5, 0) AS INT) AS width, CAST(round_even((1000 + l_suppkey % 77) * 1.5, 0) AS INT) AS height,
  CAST('0x' || substr(md5('run1:' || printf('p%03d_%02d', l_orderkey, l_linenumber)), 1, 8) AS BIGINT) AS seed,
  'run1/' || printf('p%03d_%02d', l_orderkey, l_linenumber) AS filename_prefix FROM lineitem""")
def image_jobs(t):
    from ..functions.seeds import seed32
    key = F.format_string("p%03d_%02d", "l_orderkey", "l_linenumber")
    d = t.lineitem.select(
        key.alias("key"), (1000 + F.col("l_partkey") % 99).alias("bw"), (1000 + F.col("l_suppkey") % 77).alias("bh"),
        seed32(F.concat(F.lit("run1:"), key)).alias("s"))
    return shape.image_jobs(d, "run1", panel="key", width="bw", height="bh", seed="s", hd=True)


@query("select_units", """
WITH w AS (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels)
SELECT doc_id, true AS known FROM documents WHERE doc_id IN (SELECT doc_id FROM w)
UNION ALL SELECT doc_id, false FROM w WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def select_units(t):
    kept, unknown = shape.select_units(t.documents, "doc_id", t.labels.select((F.col("doc_id") * 3).alias("doc_id")))
    return kept.select("doc_id", F.lit(True).alias("known")).unionByName(unknown.select("doc_id", F.lit(False).alias("known")))


@query("unify_aliases", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE json_extract_string(props, '$.k') END AS k,
  CASE WHEN event_type = 'click' OR event_type = 'view' AND event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS note,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no record' ELSE 'not JSON' END END AS wrong FROM events""")
def unify_aliases(t):
    k = F.get_json_object("props", "$.k")
    uid = F.col("user_id").cast("string")
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    raw = (
        F.when((kind == "view") & even, F.concat(F.lit('[{"x": 1}, [{"y": {"Key": '), k, F.lit('}}, {"NOTE": '), uid, F.lit("}]]")))  # two records, list in list
        .when(kind == "view", F.concat(F.lit('{"Key": '), k, F.lit(', "text": {"note": "not of the record"}}')))
        .when(kind == "click", F.concat(F.lit('{"KEYS": "-", "k": '), k, F.lit(', "Remark": "'), uid, F.lit('"}')))
        .when(kind == "signup", F.concat(F.lit('[{"x": 1}, {"keys": '), k, F.lit("}]")))
        .when((kind == "purchase") & even, F.concat(F.lit('{"a": {"x": 2}, "wrap": {"deep": [3, {"K": '), k, F.lit("}]}}")))
        .when(kind == "purchase", F.concat(F.lit('{"wrap": {"K": '), k, F.lit("}}")))
        .otherwise(F.when(F.col("event_id") % 3 == 1, '{"other": 1}').when(F.col("event_id") % 3 == 0, '{"k": 1'))
    )
    d = shape.unify_aliases(t.events.select("event_id", raw.alias("raw")), "raw", {"k": ["k", "key", "keys"], "note": ["note", "remark"]}, error="wrong")
    return d.drop("raw")


@query("unify_aliases_bare", """
SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN '[{"name":"' || s_name || '"},{"name":"b","x":1}]' ELSE '[{"name":"' || s_name || '"}]' END AS characters, '' AS style_notes FROM supplier""")
def unify_aliases_bare(t):
    from ..functions import fixed

    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('[{"name":"'), "s_name", F.lit('"},{"name":"b","x":1}]'))).otherwise(F.concat(F.lit('{"name":"'), "s_name", F.lit('"}')))
    d = shape.unify_aliases(t.supplier.select("s_suppkey", raw.alias("raw")), "raw", fixed.RECORD_ALIASES, bare=("characters", "name"))
    return d.select("s_suppkey", "characters", "style_notes")


@query("normalise_category", """
SELECT doc_id, CASE WHEN lower(lang) IN ('en', 'english') THEN 'english' WHEN lower(lang) = 'fr' THEN 'french'
  WHEN contains(text, ' der ') THEN 'german' ELSE 'other' END AS language FROM documents""")
def normalise_category(t):
    d = shape.normalise_category(
        t.documents, "lang", {"english": ["en", "english"], "french": ["fr"]}, [(F.col("text").contains(" der "), "german")], "other", "language")
    return d.select("doc_id", "language")


@query("normalise_role", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'machine' ELSE
  CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END END AS side FROM conversations""")
def normalise_role(t):
    d = shape.normalise_category(
        t.conversations, "role", {"human": ["user"], "machine": ["assistant", "bot"]}, [(F.length("text") > 100, "long")], "short", "side")
    return d.select("conv_id", "turn", "side")


@query("split_qualified", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE regexp_extract(d, '^(.+?)[（(](.+?)[）)]', 1) END AS name,
  CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE regexp_extract(d, '^(.+?)[（(](.+?)[）)]', 2) END AS origin
FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN s_name || '（n' || s_nationkey || '）' WHEN 1 THEN s_name || '(x' || s_nationkey || ') tail' ELSE s_name END AS d FROM supplier)""")
def split_qualified(t):
    n = F.col("s_nationkey").cast("string")
    m = F.col("s_suppkey") % 3
    deco = F.when(m == 0, F.concat("s_name", F.lit("（n"), n, F.lit("）"))).when(m == 1, F.concat("s_name", F.lit("(x"), n, F.lit(") tail"))).otherwise(F.col("s_name"))
    return shape.split_qualified(t.supplier.select("s_suppkey", deco.alias("d")), "d", "name", "origin").drop("d")


@query("quarantine", """
SELECT event_id, len(e) = 0 AS clean, array_to_string(e, '|') AS errors FROM (
  SELECT event_id, list_filter([CASE WHEN value > 60 THEN 'value high' END, CASE WHEN props LIKE '%9}' THEN 'props odd' END,
    CASE WHEN event_type = 'error' THEN 'event error' END], lambda x: x IS NOT NULL) AS e FROM events)""")
def quarantine(t):
    errs = shape.rule_errors({
        "value high": F.col("value") > 60, "props odd": F.col("props").endswith("9}"), "event error": F.col("event_type") == "error"})
    good, bad = shape.quarantine(t.events.select("event_id", errs.alias("errors")), "errors")
    return good.select("event_id", F.lit(True).alias("clean"), F.lit("").alias("errors")).unionByName(
        bad.select("event_id", F.lit(False).alias("clean"), F.array_join("errors", "|").alias("errors")))
