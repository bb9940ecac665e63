"""Queries on order-dependent operators, sets and sorts."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import sets, sorting, windows as wn
from .join_queries import STAGE_LEDGER_SQL, stage_ledger
from .registry import query
from .views import PANEL_ORDER, panel_blocks

_O = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("global_order", f"SELECT l_orderkey, {_O}, row_number() OVER (ORDER BY l_orderkey, {_O}) AS position FROM lineitem")
def global_order(t):
    return wn.global_order(t.lineitem.select("l_orderkey", *PANEL_ORDER), "l_orderkey", PANEL_ORDER, blocks=panel_blocks())


@query("chunk", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS chunk FROM conversations")
def chunk(t):
    return wn.chunk(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], 4)


@query("with_previous", """SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN '(start)' ELSE coalesce(nullif(lag(s) OVER w, ''), '(missing)') END AS previous
FROM (SELECT *, CASE WHEN role = 'system' THEN '' ELSE text END AS s FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def with_previous(t):
    s = F.when(F.col("role") == "system", "").otherwise(F.col("text"))
    return wn.with_previous(t.conversations.select("conv_id", "turn", s.alias("s")), ["conv_id"], ["turn"], "s", "(start)", "(missing)").drop("s")


@query("continuity", f"""
WITH d AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_O}) AS r, CAST(l_linenumber - 1 AS INT) * 2 AS s, l_linenumber * 2 + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS e, l_quantity / 2 AS dur FROM lineitem),
p AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY r) AS pe FROM d)
SELECT l_orderkey, arg_min(s, r) = 0 AS starts_at_zero, min(r) FILTER (pe <> s) AS first_break, arg_max(e, r) >= floor(max(dur)) AS reaches_end FROM p GROUP BY 1""")
def continuity(t):
    d = t.lineitem.select(
        "l_orderkey", *PANEL_ORDER, ((F.col("l_linenumber") - 1) * 2).alias("s"),
        (F.col("l_linenumber") * 2 + F.when(F.col("l_partkey") % 17 == 0, 1).otherwise(0)).alias("e"), (F.col("l_quantity") / 2).alias("dur"))
    return wn.continuity(d, ["l_orderkey"], PANEL_ORDER, "s", "e", "dur", panel_blocks())


@query("monotone_timestamps", r"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 4 AS dur, '[Shot 1] x [Shot 2] At 00:0' || CAST(l_partkey % 10 AS INT) || '.500, y ' ||
   CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '[Shot 3] At 00:0' || CAST(l_suppkey % 10 AS INT) || '.250, z' END AS p FROM lineitem),
e AS (SELECT *, l_partkey % 10 + 0.5 AS t2, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 10 + 0.25 END AS t3 FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|', CASE WHEN t3 <= t2 THEN 'times not increasing' END,
  CASE WHEN t2 >= dur OR coalesce(t3 >= dur, false) THEN 'time out of range' END) AS errors FROM e""")
def monotone_timestamps(t):
    two = F.concat(F.lit("[Shot 1] x [Shot 2] At 00:0"), (F.col("l_partkey") % 10).cast("string"), F.lit(".500, y "))
    three = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("[Shot 3] At 00:0"), (F.col("l_suppkey") % 10).cast("string"), F.lit(".250, z")))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(two, three).alias("p"), (F.col("l_quantity") / 4).alias("dur"))
    return d.withColumn("errors", F.array_join(wn.shot_errors(F.col("p"), F.col("dur")), "|")).drop("p", "dur")


@query("crossfade_offsets", f"""
SELECT l_orderkey, {_O}, clip, CASE WHEN clip > 1 THEN CAST(b - (clip - 1) * CAST(0.45 AS DECIMAL(10,3)) AS DOUBLE) END AS "offset" FROM (
  SELECT l_orderkey, {_O}, row_number() OVER w AS clip, sum(CAST(l_quantity AS DECIMAL(18,3))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_O}))""")
def crossfade_offsets(t):
    d = t.lineitem.select("l_orderkey", *PANEL_ORDER, "l_quantity")
    return wn.crossfade_offsets(d, ["l_orderkey"], PANEL_ORDER, "l_quantity", blocks=panel_blocks()).drop("l_quantity")


@query("crossfade_total", "SELECT l_orderkey, count(*) AS clips, CAST(sum(CAST(l_quantity AS DECIMAL(18,3))) - (count(*) - 1) * CAST(0.45 AS DECIMAL(10,3)) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def crossfade_total(t):
    return wn.crossfade_total(t.lineitem, ["l_orderkey"], "l_quantity")


def dialogue_boxes(t):
    kind = F.when(F.col("role") == "system", "narration").when(F.col("role") == "user", "bubble").otherwise("sfx")
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", kind.alias("kind"), (n % 200 + 50).alias("bw"), (n % 90 + 20).alias("bh"), F.lit(1024).alias("pw"), F.lit(1408).alias("ph"))


@query("stack_layout", """
WITH d AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'narration' WHEN 'user' THEN 'bubble' ELSE 'sfx' END AS kind, length(text) % 200 + 50 AS bw, length(text) % 90 + 20 AS bh FROM conversations),
e AS (SELECT *, coalesce(sum(bh + 28) OVER (PARTITION BY conv_id, kind ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM d)
SELECT conv_id, turn, kind, CASE WHEN kind = 'bubble' THEN 1024 - bw - 30 ELSE 30 END / 1024 AS x, CASE WHEN kind = 'sfx' THEN 1408 - bh - 30 ELSE 30 + above END / 1408 AS y FROM e""")
def stack_layout(t):
    return wn.stack_layout(dialogue_boxes(t), ["conv_id"], "kind", ["turn"], "bw", "bh", "pw", "ph").select("conv_id", "turn", "kind", "x", "y")


@query("last_wins", "SELECT text, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, count(*) - 1 AS replaced FROM documents GROUP BY 1")
def last_wins(t):
    return wn.last_wins(t.documents.select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("first_seen", "SELECT unnest(string_split(text, ' ')) AS word, min(conv_id) AS first_chunk FROM conversations GROUP BY 1".replace(
    "SELECT unnest(string_split(text, ' ')) AS word, min(conv_id) AS first_chunk FROM conversations GROUP BY 1",
    "SELECT word, min(conv_id) AS first_chunk FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1"))
def first_seen(t):
    return wn.first_seen(_words(t), "word", "conv_id")


def _words(t):
    return t.conversations.select("conv_id", F.explode(F.split("text", " ")).alias("word"))


@query("roster_sizes", """
WITH f AS (SELECT word, min(conv_id) AS c FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1),
n AS (SELECT c.conv_id, count(f.word) AS n_new FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.c = c.conv_id GROUP BY 1)
SELECT conv_id, n_new, CAST(coalesce(sum(n_new) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM n""")
def roster_sizes(t):
    return wn.roster_sizes(_words(t), "word", "conv_id")


@query("assign_lanes", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS INT) AS lane FROM orders")
def assign_lanes(t):
    return wn.assign_lanes(t.orders.select("o_orderkey"), ["o_orderkey"], 3)


_HOOK = "CASE event_type WHEN 'click' THEN 'reveal' WHEN 'view' THEN 'callback' WHEN 'purchase' THEN 'tender' WHEN 'signup' THEN 'suspense' ELSE 'none' END"


@query("shot_table_gate", f"""
WITH d AS (SELECT user_id, event_id, {_HOOK} AS hook, value / 10 AS secs, CAST(event_id % 40 % 5 AS INT) AS people, CAST(value / 9 AS INT) AS covered,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT *, count(*) FILTER (hook IN ('reveal', 'reversal', 'callback')) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS turns FROM d)
SELECT user_id, NOT bool_or(r >= 3 AND turns = 0) AS hooks_dense,
  bool_or(r = 1 AND hook IN ('visual-joke', 'reversal', 'reveal', 'suspense', 'tender')) AND bool_or(r = n AND hook IN ('visual-joke', 'reversal', 'reveal', 'suspense', 'tender')) AS ends_strong,
  max(secs) <= 15 AS short_enough, max(people) <= 3 AS cast_ok, bool_and(covered >= ceil(secs)) AS seconds_covered FROM g GROUP BY 1""".replace("CAST(value / 9 AS INT)", "CAST(trunc(value / 9) AS INT)"))
def shot_table_gate(t):
    k = F.col("event_type")
    hook = F.when(k == "click", "reveal").when(k == "view", "callback").when(k == "purchase", "tender").when(k == "signup", "suspense").otherwise("none")
    d = t.events.select("user_id", "ts", "event_id", hook.alias("hook"), (F.col("value") / 10).alias("secs"),
                        (F.col("event_id") % 40 % 5).cast("int").alias("people"), (F.col("value") / 9).cast("int").alias("covered"))
    return wn.shot_table_gate(d, ["user_id"], ["ts", "event_id"], "hook", "secs", "people", "covered", [F.date_trunc("hour", "ts")])


@query("stage_overlap", """
WITH p AS (SELECT user_id, event_type, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1, 2)
SELECT a.user_id, a.event_type AS stage_a, b.event_type AS stage_b, greatest(a.s, b.s) < least(a.e, b.e) AS overlaps,
  CASE WHEN greatest(a.s, b.s) < least(a.e, b.e) THEN date_sub('second', greatest(a.s, b.s), least(a.e, b.e)) ELSE 0 END AS seconds
FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type""")
def stage_overlap(t):
    e = t.events
    return wn.stage_overlap(e, "user_id", "event_type", "ts", "ts")


@query("required_tokens_missing", """
WITH d AS (SELECT p_partkey, replace(p_name, ' ', ', ') AS app, lower(p_type) AS st,
  CASE p_partkey % 3 WHEN 0 THEN '(' || split_part(p_name, ' ', 1) || ':1.2), ' || upper(split_part(p_name, ' ', 2)) WHEN 1 THEN split_part(p_name, ' ', 1) || ', (' || lower(p_type) || ')' ELSE p_type END AS pres FROM part),
have AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [split_part(app, ', ', 1), split_part(app, ', ', 2)] WHEN 1 THEN [split_part(app, ', ', 1), st] ELSE [st] END AS h, app, st FROM d)
SELECT p_partkey, array_to_string(list_filter([split_part(app, ', ', 1), split_part(app, ', ', 2), st], lambda x: NOT list_contains(h, x)), '|') AS missing FROM have""")
def required_tokens_missing(t):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    m = F.col("p_partkey") % 3
    present = (F.when(m == 0, F.concat(F.lit("("), a, F.lit(":1.2), "), F.upper(b)))
               .when(m == 1, F.concat(a, F.lit(", ("), F.lower("p_type"), F.lit(")"))).otherwise(F.col("p_type")))
    d = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("app"), F.lower("p_type").alias("st"), present.alias("pres"))
    return sets.required_tokens_missing(d, "app", "st", "pres").select("p_partkey", F.array_join("missing", "|").alias("missing"))


@query("exact_cover", """
WITH u AS (SELECT o_custkey % 50 AS grp, CASE WHEN o_orderkey % 11 = 3 THEN -o_orderkey ELSE o_orderkey END AS unit, o_orderkey AS pos FROM orders),
s AS (SELECT o_custkey % 50 AS grp, CASE WHEN o_orderkey % 13 = 4 THEN -o_orderkey ELSE o_orderkey END AS unit, CASE WHEN o_orderkey % 101 = 5 THEN o_orderkey + 2500 ELSE o_orderkey END AS pos FROM orders
      UNION ALL SELECT o_custkey % 50, o_orderkey, o_orderkey + 100000 FROM orders WHERE o_orderkey % 97 = 0),
nu AS (SELECT grp, unit, count(*) AS n FROM s GROUP BY 1, 2),
sing AS (SELECT nu.grp, nu.unit FROM nu JOIN u USING (grp, unit) WHERE n = 1),
a AS (SELECT s.grp, s.unit, row_number() OVER (PARTITION BY s.grp ORDER BY s.pos, s.unit) AS a FROM s JOIN sing USING (grp, unit)),
b AS (SELECT u.grp, u.unit, row_number() OVER (PARTITION BY u.grp ORDER BY u.pos) AS b FROM u JOIN sing USING (grp, unit))
SELECT grp, unit, 'missing' AS problem FROM u WHERE (grp, unit) NOT IN (SELECT (grp, unit) FROM nu)
UNION ALL SELECT grp, unit, 'unknown' FROM nu WHERE (grp, unit) NOT IN (SELECT (grp, unit) FROM u)
UNION ALL SELECT nu.grp, nu.unit, 'duplicate' FROM nu JOIN u USING (grp, unit) WHERE n > 1
UNION ALL SELECT grp, unit, 'order' FROM a JOIN b USING (grp, unit) WHERE a <> b""")
def exact_cover(t):
    o = t.orders.select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("unit"))
    lost = lambda n, m: F.when(F.col("unit") % n == m, -F.col("unit")).otherwise(F.col("unit"))
    u = o.withColumn("pos", F.col("unit")).withColumn("unit", lost(11, 3))
    s = o.withColumn("pos", F.when(F.col("unit") % 101 == 5, F.col("unit") + 2500).otherwise(F.col("unit"))).withColumn("unit", lost(13, 4)).unionByName(
        o.where("unit % 97 = 0").withColumn("pos", F.col("unit") + 100000))
    return sets.exact_cover(s, u, ["grp"], "unit", ["pos", "unit"], ["pos"])


@query("residual_issues", """
WITH n AS (SELECT source AS file, CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || doc_id % 5 END AS problem, doc_id FROM documents),
c AS (SELECT source AS file, CASE WHEN doc_id % 29 = 1 THEN lang ELSE lang || '?' END AS problem, doc_id FROM documents)
SELECT * FROM n WHERE (file, problem) NOT IN (SELECT (file, problem) FROM c) UNION ALL SELECT * FROM c""")
def residual_issues(t):
    problem = lambda n, m, more: F.when(F.col("doc_id") % n == m, F.col("lang")).otherwise(F.concat("lang", more)).alias("problem")
    issues = lambda p: t.documents.select(F.col("source").alias("file"), p, "doc_id")
    return sets.residual_issues(issues(problem(3, 0, (F.col("doc_id") % 5).cast("string"))), issues(problem(29, 1, F.lit("?"))))


@query("recheck_scope", """
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.07)""")
def recheck_scope(t):
    units = t.orders.select("o_custkey", "o_orderkey")
    changed = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    revised = t.lineitem.where("l_returnflag = 'R' AND l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey")).join(units, "o_orderkey")
    return sets.recheck_scope(units, "o_custkey", changed, revised, "o_orderkey")


_STG = "[" + ", ".join(f"'{s}'" for s in fixed.STAGES) + "]"


@query("next_pending", f"""WITH {STAGE_LEDGER_SQL}, g AS (SELECT r.run, s.stage, list_position({_STG}, s.stage) AS o FROM (SELECT DISTINCT run FROM cur) r, (SELECT unnest({_STG}) AS stage) s)
SELECT g.run, arg_min(g.stage, g.o) FILTER (cur.status IS NULL OR cur.status <> 'completed') AS next_stage FROM g LEFT JOIN cur ON cur.run = g.run AND cur.stage = g.stage GROUP BY 1""")
def next_pending(t):
    return sorting.next_pending(_current(t), "run", "stage", "status")


def _current(t):
    return stage_ledger(t).groupBy("run", "stage").agg(F.max_by("status", "ts").alias("status"))


@query("stage_strip", f"""WITH {STAGE_LEDGER_SQL}, g AS (SELECT r.run, s.stage, list_position({_STG}, s.stage) AS o FROM (SELECT DISTINCT run FROM cur) r, (SELECT unnest({_STG}) AS stage) s)
SELECT g.run, string_agg(CASE coalesce(cur.status, 'pending') WHEN 'pending' THEN '.' WHEN 'in_progress' THEN '>' WHEN 'completed' THEN 'C' WHEN 'failed' THEN '!' ELSE '?' END, '' ORDER BY g.o) AS strip
FROM g LEFT JOIN cur ON cur.run = g.run AND cur.stage = g.stage GROUP BY 1""")
def stage_strip(t):
    return sorting.stage_strip(_current(t), "run", "stage", "status")


@query("tail", "SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def tail(t):
    return sorting.tail(t.events.select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], 50)


@query("closest_prefix", """
WITH p AS (SELECT DISTINCT substr(s_name, 1, CAST(12 + s_suppkey % 7 AS INT)) AS prefix FROM supplier UNION SELECT 'Nobody')
SELECT prefix, count(s_name) AS n_names, arg_min(s_name, (length(s_name), s_name)) AS closest FROM p LEFT JOIN supplier ON starts_with(s_name, prefix) GROUP BY 1""")
def closest_prefix(t):
    p = t.supplier.select(F.substring("s_name", F.lit(1), (F.lit(12) + F.col("s_suppkey") % 7).cast("int")).alias("prefix")).distinct()
    p = p.unionByName(t.supplier.limit(1).select(F.lit("Nobody").alias("prefix")))
    return sorting.closest_prefix(t.supplier, "s_name", p, "prefix")
