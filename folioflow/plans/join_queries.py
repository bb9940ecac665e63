"""Queries on joins."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import joins
from .registry import query


@query("fuzzy_name_join", r"""
WITH a AS (SELECT DISTINCT p_name AS a, regexp_replace(p_name, '[\s·・。.,，:：''"“”()（）]', '', 'g') AS x FROM part),
w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
b AS (SELECT b, regexp_replace(b, '[\s·・。.,，:：''"“”()（）]', '', 'g') AS y FROM (SELECT '“' || word || '”' AS b FROM w UNION SELECT DISTINCT p_name || ' (' || p_type || ')' FROM part))
SELECT a, b FROM a, b WHERE x = y OR (length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x)))""")
def fuzzy_name_join(t):
    return joins.fuzzy_name_join(t.part, "p_name", _loose_names(t), "b")


def _loose_names(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.concat(F.lit("“"), "w", F.lit("”")).alias("b"))
    return words.unionByName(t.part.select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("b")).distinct())


@query("fuzzy_matches_or_all", r"""
WITH a AS (SELECT DISTINCT s_name AS a FROM supplier UNION SELECT DISTINCT p_name FROM part),
w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS b FROM part)
SELECT a.a, w.b FROM a LEFT JOIN w ON contains(replace(a.a, ' ', ''), w.b) OR contains(w.b, replace(a.a, ' ', ''))""")
def fuzzy_matches_or_all(t):
    a = t.supplier.select(F.col("s_name").alias("a")).unionByName(t.part.select(F.col("p_name").alias("a")))
    return joins.fuzzy_matches_or_all(a, "a", t.part.select(F.explode(F.split("p_name", " ")).alias("b")), "b")


@query("phrase_hits", """
WITH ph AS (SELECT item_id AS pid, text AS phrase FROM benchmark
  UNION ALL SELECT 100000 + item_id, text FROM benchmark
  UNION ALL SELECT 200000 + item_id, substr(text, 3, 9) FROM benchmark)
SELECT doc_id, pid FROM documents, ph WHERE trim(phrase) <> '' AND contains(text, phrase)""")
def phrase_hits(t):
    b = t.benchmark
    ph = (
        b.select(F.col("item_id").alias("pid"), F.col("text").alias("phrase"))
        .unionByName(b.select((100000 + F.col("item_id")).alias("pid"), F.col("text").alias("phrase")))
        .unionByName(b.select((200000 + F.col("item_id")).alias("pid"), F.substring("text", 3, 9).alias("phrase")))
    )
    return joins.phrase_hits(t.documents, "doc_id", "text", ph, "pid", "phrase")


@query("mention_join", r"""
WITH al AS (SELECT item_id // 2 AS entity, item_id AS ord, lower(text) AS alias FROM benchmark),
hit AS (SELECT doc_id, entity, min(ord) AS ord FROM documents, al WHERE contains(lower(text), alias) GROUP BY 1, 2)
SELECT doc_id, entity, ord, 'matched' AS outcome FROM hit
UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) <= 2 OR contains(text, '（无）') OR contains(text, '(无)') THEN 'empty' ELSE 'needs_model' END
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def mention_join(t):
    al = t.benchmark.select(F.floor(F.col("item_id") / 2).alias("entity"), F.col("item_id").alias("ord"), F.col("text").alias("alias"))
    return joins.mention_join(t.documents.select("doc_id", "text"), "doc_id", "text", al, "entity", "ord", "alias")


@query("resume", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def resume(t):
    ledger = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"))
    outputs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.resume(t.orders.select("o_orderkey"), ledger, outputs, ["o_orderkey"])


@query("missing_expected", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_expected(t):
    return joins.missing_expected(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("pick_mode", """
SELECT o_orderkey, style, CASE WHEN style = '2d' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) THEN 'i2va' ELSE 't2va' END AS mode
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority < '4' THEN '2d' ELSE '3d' END AS style FROM orders)""")
def pick_mode(t):
    seg = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") < "4", "2d").otherwise("3d").alias("style"))
    frames = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pick_mode(seg, frames, "o_orderkey", "style")


@query("prefer_variant", """
SELECT doc_id, coalesce('q' || quality, source) AS path, quality IS NOT NULL AS is_variant FROM documents LEFT JOIN labels USING (doc_id)""")
def prefer_variant(t):
    base = t.documents.select("doc_id", F.col("source").alias("path"))
    variant = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("path"))
    return joins.prefer_variant(base, variant, ["doc_id"], ["path"])


@query("verbatim_missing", """
WITH r AS (SELECT item_id AS doc_id, text AS wanted FROM benchmark
  UNION ALL SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 12) WHEN 1 THEN '（' || lang || '）' WHEN 2 THEN '  ' ELSE source || lang END FROM documents)
SELECT doc_id, wanted FROM r JOIN documents USING (doc_id)
WHERE trim(wanted) <> '' AND NOT (wanted LIKE '（%）') AND NOT contains(text, regexp_replace(wanted, '^\\s+|\\s+$', '', 'g'))""".replace("\\\\", "\\"))
def verbatim_missing(t):
    m = F.col("doc_id") % 4
    own = F.when(m == 0, F.substring("text", 5, 12)).when(m == 1, F.concat(F.lit("（"), "lang", F.lit("）"))).when(m == 2, "  ").otherwise(F.concat("source", "lang"))
    need = t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("wanted")).unionByName(
        t.documents.select("doc_id", own.alias("wanted")))
    return joins.verbatim_missing(need, t.documents, ["doc_id"], "wanted", "text")


_GUARD_2D = fixed.STYLE_GUARDS["2d"]


@query("attach_style", f"""
WITH d AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '2d' WHEN '2' THEN '3d' WHEN '3' THEN 'live' ELSE 'x' END AS style,
  'seg ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' {_GUARD_2D}' ELSE '' END AS text FROM orders),
g AS (SELECT *, CASE style WHEN '2d' THEN '{_GUARD_2D}' WHEN '3d' THEN '{fixed.STYLE_GUARDS["3d"]}' WHEN 'live' THEN '{fixed.STYLE_GUARDS["live"]}' END AS g FROM d)
SELECT o_orderkey, style, CASE WHEN g IS NULL OR contains(text, g) THEN text ELSE text || ' ' || g END AS text,
  CASE WHEN g IS NULL THEN 'unknown style ' || style END AS style_error FROM g""")
def attach_style(t):
    p = F.substring("o_orderpriority", 1, 1)
    style = F.when(p == "1", "2d").when(p == "2", "3d").when(p == "3", "live").otherwise("x")
    text = F.concat(F.lit("seg "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" " + _GUARD_2D)).otherwise(F.lit("")))
    return joins.attach_style(t.orders.select("o_orderkey", style.alias("style"), text.alias("text")), "style", "text")


@query("final_units", """
SELECT DISTINCT event_id % 2000 AS unit FROM events WHERE event_type IN ('purchase', 'signup')
  AND event_id % 2000 NOT IN (SELECT event_id % 2000 FROM events WHERE event_type = 'error')""")
def final_units(t):
    e = t.events.select((F.col("event_id") % 2000).alias("unit"), "event_type")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "needs_review").otherwise("pending")
    return joins.final_units(e.withColumn("status", status), e.where("event_type = 'error'"), ["unit"])


@query("panel_context", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS page_text, c_name AS card
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def panel_context(t):
    pages = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("page_text"))
    cards = t.customer.where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("card"))
    return joins.panel_context(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), pages, cards, "l_orderkey", "c_custkey").drop("c_custkey")


def stage_ledger(t):
    """Stage rows of one run per user."""
    stage = F.element_at(F.array(*[F.lit(s) for s in fixed.STAGES]), ((F.col("event_id") * 7 + F.col("user_id")) % 10 + 1).cast("int"))
    v = F.col("event_id") % 5
    status = F.when(v < 3, "completed").when(v == 3, "failed").otherwise("in_progress")
    return t.events.select(F.col("user_id").alias("run"), stage.alias("stage"), status.alias("status"), "ts", "event_id")


STAGE_LEDGER_SQL = """sl AS (SELECT user_id AS run, [{stages}][(event_id * 7 + user_id) % 10 + 1] AS stage,
  CASE WHEN event_id % 5 < 3 THEN 'completed' WHEN event_id % 5 = 3 THEN 'failed' ELSE 'in_progress' END AS status, ts, event_id FROM events),
cur AS (SELECT run, stage, arg_max(status, ts) AS status FROM sl GROUP BY 1, 2)""".format(stages=", ".join(f"'{s}'" for s in fixed.STAGES))
_DEPS_SQL = "dep(stage, dep) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fixed.STAGE_DEPS) + ")"
_STATES_SQL = f"""WITH RECURSIVE {STAGE_LEDGER_SQL}, {_DEPS_SQL},
grid AS (SELECT r.run, s.stage, cur.status FROM (SELECT DISTINCT run FROM sl) r, (SELECT unnest([{", ".join(f"'{s}'" for s in fixed.STAGES)}]) AS stage) s
  LEFT JOIN cur ON cur.run = r.run AND cur.stage = s.stage),
skp AS (SELECT g.run, g.stage FROM grid g JOIN dep ON dep.stage = g.stage JOIN grid u ON u.run = g.run AND u.stage = dep.dep
    WHERE u.status = 'failed' AND (g.status IS NULL OR g.status NOT IN ('completed', 'failed'))
  UNION SELECT g.run, g.stage FROM skp JOIN dep ON dep.dep = skp.stage JOIN grid g ON g.run = skp.run AND g.stage = dep.stage
    WHERE g.status IS NULL OR g.status NOT IN ('completed', 'failed'))"""


@query("ready_stages", _STATES_SQL + """
SELECT g.run, g.stage FROM grid g WHERE (g.status IS NULL OR g.status NOT IN ('completed', 'failed'))
AND NOT EXISTS (SELECT 1 FROM dep JOIN grid u ON u.stage = dep.dep WHERE dep.stage = g.stage AND u.run = g.run AND (u.status IS NULL OR u.status <> 'completed'))""")
def ready_stages(t):
    return joins.ready_stages(stage_ledger(t), "run", "stage", "status")


@query("skip_cascade", _STATES_SQL + " SELECT run, stage FROM skp")
def skip_cascade(t):
    return joins.skip_cascade(stage_ledger(t), "run", "stage", "status")
