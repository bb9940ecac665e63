"""Queries on roll-ups."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import aggregates as ag
from .registry import query
from .source_queries import log_lines
from .views import PANEL_ORDER, panel_blocks


@query("manifest_rollup", "SELECT source, count(*) AS n, count(*) FILTER (n_chars < 500) AS n_flagged, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def manifest_rollup(t):
    return ag.manifest_rollup(t.documents, ["source"], F.col("n_chars") < 500, "doc_id")


@query("item_status_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def item_status_counts(t):
    return ag.item_status_counts(t.events, ["user_id"], "event_type")


@query("item_status_totals", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)")
def item_status_totals(t):
    return ag.item_status_counts(t.events, ["user_id"], "event_type", rollup=True)


@query("item_status_wide", """SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
  count(*) FILTER (event_type = 'view') AS n_view, count(*) AS total FROM events GROUP BY 1""")
def item_status_wide(t):
    return ag.item_status_wide(t.events, ["user_id"], "event_type", ["click", "error", "view"])


def checked_docs(t):
    ini = F.when(F.col("n_chars") < 500, 1).otherwise(0) + F.when(F.col("lang") != "en", 1).otherwise(0)
    return t.documents.select("doc_id", "source", ini.alias("initial"), F.when(F.col("lang") == "de", 1).otherwise(0).alias("final"))


_CHECKED = "c AS (SELECT doc_id, source, CASE WHEN n_chars < 500 THEN 1 ELSE 0 END + CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS ini, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS fin FROM documents)"


@query("check_rollup", f"WITH {_CHECKED} SELECT source, count(*) FILTER (ini = 0 AND fin = 0) AS passed, count(*) FILTER (ini > 0 AND fin = 0) AS repaired, count(*) FILTER (fin > 0) AS unresolved FROM c GROUP BY 1")
def check_rollup(t):
    return ag.check_rollup(checked_docs(t), ["source"], "initial", "final")


@query("unresolved_units", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def unresolved_units(t):
    return ag.unresolved_units(checked_docs(t), "final").select("doc_id", "source")


def attempts_of_events(t):
    """Three events of a row are the attempts of one unit; some units have fewer, some break."""
    infra = (F.col("event_type") == "signup") & (F.col("value") > 80)
    return t.events.select(
        F.floor(F.col("event_id") / 3).alias("unit"), (F.col("event_id") % 3).cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("passed"), F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("int").cast("string")).alias("points"),
        infra.alias("infra"))


ATTEMPTS_SQL = """att AS (SELECT event_id // 3 AS unit, CAST(event_id % 3 AS INT) AS attempt, event_type <> 'error' AS passed,
  CASE WHEN event_type = 'view' THEN 0 ELSE least(10, greatest(0, CAST(trunc(value) AS INT))) END AS score,
  event_type = 'signup' AND value > 80 AS infra FROM events),
shut AS (SELECT unit, min(attempt) AS closing FROM att WHERE infra OR (passed AND score >= 7) GROUP BY 1),
counted AS (SELECT att.*, closing FROM att LEFT JOIN shut USING (unit) WHERE closing IS NULL OR attempt <= closing),
fin AS (SELECT unit, count(*) FILTER (NOT infra) AS n_attempts, max(attempt) FILTER (NOT infra) AS final_attempt,
  arg_max(attempt, (score, -attempt)) FILTER (NOT infra) AS best_attempt, arg_max(score, attempt) FILTER (NOT infra) AS final_score,
  bool_or(infra) AS broken, max(closing) AS closing FROM counted GROUP BY 1),
outc AS (SELECT unit, n_attempts, final_attempt, best_attempt, final_score,
  CASE WHEN broken THEN 'failed' WHEN closing IS NOT NULL THEN 'completed' WHEN n_attempts >= 3 THEN 'needs_review' ELSE 'pending' END AS status FROM fin)"""


@query("final_attempt", f"WITH {ATTEMPTS_SQL} SELECT * FROM outc")
def final_attempt(t):
    return ag.final_attempt(attempts_of_events(t), ["unit"], "attempt", "passed", "points", "infra")


@query("attempt_qc", f"""WITH {ATTEMPTS_SQL}, q AS (SELECT count(*) AS units, count(*) FILTER (status = 'completed' AND final_attempt = 0) / count(*) AS first_pass_rate,
  CAST(sum(n_attempts) AS BIGINT) / count(*) AS mean_attempts, count(*) FILTER (status = 'needs_review') / count(*) AS review_rate, CAST(sum(final_score) AS BIGINT) / count(*) AS mean_score FROM outc WHERE n_attempts > 0)
SELECT *, first_pass_rate >= 0.5 AS first_pass_ok, mean_attempts <= 1.8 AS attempts_ok, review_rate <= 0.1 AS review_ok, mean_score >= 7.0 AS score_ok FROM q""")
def attempt_qc(t):
    return ag.attempt_qc(final_attempt(t))


@query("accept", "SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND least(10, greatest(0, CAST(trunc(value) AS INT))) >= 7 AS ok FROM events")
def accept(t):
    d = t.events.select("event_id", (F.col("event_type") != "error").alias("passed"),
                        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("int").cast("string")).alias("points"))
    return d.select("event_id", ag.accepted("passed", "points").alias("ok"))


_SEX = "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Woman' WHEN 'MACHINERY' THEN '男' WHEN 'FURNITURE' THEN 'girl' ELSE 'robot' END"


def _members(t):
    m = F.col("c_mktsegment")
    sex = F.when(m == "HOUSEHOLD", "Woman").when(m == "MACHINERY", "男").when(m == "FURNITURE", "girl").otherwise("robot")
    return t.customer.select(F.floor(F.col("c_custkey") / 3).alias("grp"), "c_custkey", sex.alias("sex"))


_SEX_SQL = f"m AS (SELECT c_custkey // 3 AS grp, count(*) FILTER ({_SEX} IN ('Woman', 'girl')) AS f, count(*) FILTER ({_SEX} = '男') AS m FROM customer GROUP BY 1)"


@query("count_tag", f"""WITH {_SEX_SQL} SELECT grp, CASE WHEN f = 0 AND m = 0 THEN 'no humans' ELSE concat_ws(', ',
  CASE WHEN f = 1 THEN '1girl' WHEN f > 1 THEN f || 'girls' END, CASE WHEN m = 1 THEN '1boy' WHEN m > 1 THEN m || 'boys' END) END AS count_tag FROM m""")
def count_tag(t):
    return ag.count_tag(_members(t), ["grp"], "sex")


@query("exclusive_negatives", f"""WITH {_SEX_SQL} SELECT grp, concat_ws(', ', CASE WHEN f > 0 AND m = 0 THEN '{", ".join(fixed.EXCLUDE_WHEN_FEMALE)}'
  WHEN m > 0 AND f = 0 THEN '{", ".join(fixed.EXCLUDE_WHEN_MALE)}' END, 'lowres') AS negative FROM m""")
def exclusive_negatives(t):
    return ag.exclusive_negatives(_members(t), ["grp"], "sex", F.lit("lowres"))


@query("attribute_conflicts", "SELECT text FROM (SELECT text, count(DISTINCT CASE WHEN lang = 'es' THEN '' ELSE source END) AS n FROM documents GROUP BY 1) WHERE n > 1")
def attribute_conflicts(t):
    d = t.documents.select("text", F.when(F.col("lang") != "es", F.col("source")).alias("attr"))
    return ag.attribute_conflicts(d, ["text"], "attr")


@query("ordered_concat", """SELECT conv_id, (r - 1) // 4 AS part, string_agg(turn || ' ' || role || ': ' || text, chr(10) ORDER BY turn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1, 2""")
def ordered_concat(t):
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), "text")
    return ag.ordered_concat(t.conversations, ["conv_id"], ["turn"], line, part_rows=4)


_AT = "max(value) FILTER (i = {f}((n - 1) * {q}::DOUBLE))"
_MIX = "CASE WHEN {lo} = {hi} THEN {lo} ELSE (ceil(max((n - 1) * {q}::DOUBLE)) - max((n - 1) * {q}::DOUBLE)) * {lo} + (max((n - 1) * {q}::DOUBLE) - floor(max((n - 1) * {q}::DOUBLE))) * {hi} END"


def _quantile_sql(q):
    return _MIX.format(lo=_AT.format(f="floor", q=q), hi=_AT.format(f="ceil", q=q), q=q)


@query("latency_profile", f"""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, {_quantile_sql("0.5")} AS median, {_quantile_sql("0.9")} AS p90, max(value) AS max FROM r GROUP BY 1""")
def latency_profile(t):
    return ag.latency_profile(t.events, ["event_type"], "value")


# no SQL text: the sketch is exact only while a group is smaller than its accuracy
@query("latency_profile_approx")
def latency_profile_approx(t):
    return ag.latency_profile(t.events, ["event_type"], "value", exact=False)


# each answer's exact rank range must reach the asked rank within twice the stated error
@query("latency_sketch_rollup", """SELECT event_type, CAST(ts AS DATE) AS day, grouping(event_type, CAST(ts AS DATE)) AS level, count(*) AS n, max(value) AS max, true AS median_within, true AS p90_within
FROM events WHERE value IS NOT NULL GROUP BY ROLLUP (event_type, CAST(ts AS DATE))""")
def latency_sketch_rollup(t):
    events = t.events.select("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value")
    hours = ag.latency_sketches(events, ["event_type", "day", "hour"], "value")
    got = ag.latency_from_sketches(hours, ["event_type", "day"], rollup=True)
    levels = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 3)])).alias("level")
    rows = events.where("value is not null").select("event_type", "day", "value", levels).select(
        F.when(F.col("level") < 2, F.col("event_type")).alias("e"), F.when(F.col("level") < 1, F.col("day")).alias("d"), F.col("level").alias("l"), F.col("value").alias("v"))
    meet = (F.col("level") == F.col("l")) & F.col("event_type").eqNullSafe(F.col("e")) & F.col("day").eqNullSafe(F.col("d"))
    error = 2 * ag.sketch_error(2000)

    def within(answer, q):
        below, upto = F.count_if(F.col("v") < F.col(answer)), F.count_if(F.col("v") <= F.col(answer))
        n = F.col("n")
        return ((below <= (q + error) * n + 1) & (upto >= (q - error) * n - 1)).alias(f"{answer}_within")

    return rows.join(got, meet).groupBy("event_type", "day", "level", "n", "max").agg(within("median", 0.5), within("p90", 0.9))


_D = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


@query("stage_benchmark", f"""
WITH s AS (SELECT year(o_orderdate) AS stage, o_custkey % 2 AS side, o_totalprice FROM orders WHERE NOT (year(o_orderdate) = 1996 AND o_custkey % 2 = 0)),
b AS (SELECT stage, {_D.format('o_totalprice')} AS base_seconds FROM s WHERE side = 0 GROUP BY 1),
r AS (SELECT stage, {_D.format('o_totalprice')} AS run_seconds FROM s WHERE side = 1 GROUP BY 1),
t AS (SELECT {_D.format('o_totalprice')} AS t FROM s WHERE side = 1)
SELECT CAST(coalesce(b.stage, r.stage) AS INT) AS stage, base_seconds, run_seconds, (base_seconds - run_seconds) * 100 / base_seconds AS reduction_pct, run_seconds * 100 / t.t AS share_pct
FROM b FULL JOIN r ON b.stage = r.stage, t""")
def stage_benchmark(t):
    s = t.orders.select(F.year("o_orderdate").alias("stage"), (F.col("o_custkey") % 2).alias("side"), "o_totalprice").where("NOT (stage = 1996 AND side = 0)")
    return ag.stage_benchmark(s.where("side = 0"), s.where("side = 1"), "stage", "o_totalprice")


@query("render_rate", f"""SELECT l_shipmode_key, jobs, wall_seconds, output_seconds, wall_seconds / output_seconds AS seconds_per_second FROM (
  SELECT l_linenumber AS l_shipmode_key, count(*) AS jobs, {_D.format('l_extendedprice')} AS wall_seconds, {_D.format('l_quantity')} AS output_seconds FROM lineitem GROUP BY 1)""".replace("l_shipmode_key", "lane"))
def render_rate(t):
    return ag.render_rate(t.lineitem.withColumnRenamed("l_linenumber", "lane"), ["lane"], "l_extendedprice", "l_quantity")


@query("merge_entities", """SELECT l_partkey AS entity, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS l_suppkey,
  arg_min(l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) AS l_quantity, count(*) AS n_mentions FROM lineitem GROUP BY 1""")
def merge_entities(t):
    d = t.lineitem.withColumnRenamed("l_partkey", "entity")
    return ag.merge_entities(d, "entity", ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_quantity"])


@query("merge_states", """SELECT l_partkey AS entity, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS state_ord FROM lineitem""")
def merge_states(t):
    d = t.lineitem.withColumnRenamed("l_partkey", "entity")
    return ag.merge_states(d, "entity", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], ["l_extendedprice"])


@query("issues_by_file", r"""SELECT f AS file, count(*) AS n_issues, min(lang) AS first_problem FROM (
  SELECT lang, CASE WHEN doc_id % 5 = 4 THEN '00_settings.json' ELSE '02_pages/page_' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '.md' END AS f FROM documents) GROUP BY 1""")
def issues_by_file(t):
    page = F.concat(F.lit("page_"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit(".md"))
    m = F.col("doc_id") % 5
    f = (F.when(m == 0, F.concat(F.lit("./02_pages/"), page)).when(m == 1, F.concat(F.lit("s2_zero\\02_pages\\"), page))
         .when(m == 2, F.concat(F.lit(" ././02_pages/"), page, F.lit(" "))).when(m == 3, F.concat(F.lit("02_pages/"), page)).otherwise(F.lit("./00_settings.md")))
    return ag.issues_by_file(t.documents.select(f.alias("file"), "lang"), "file", "lang")


@query("script_ratio", """SELECT lang, ratio, ratio >= 0.8 AS reached FROM (SELECT lang, count(*) FILTER (regexp_matches(text, '[éèêçàùäöüßñóí]')) / count(*) AS ratio FROM documents GROUP BY 1)""")
def script_ratio(t):
    return ag.script_ratio(t.documents, ["lang"], "text", "[éèêçàùäöüßñóí]")


def media_of_panels(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", *PANEL_ORDER, q.alias("duration"),
        F.when(F.col("l_suppkey") % 9 == 0, 1920).otherwise(1280).alias("w"), F.when(F.col("l_suppkey") % 9 == 1, 960).when(F.col("l_suppkey") % 9 == 0, 1080).otherwise(720).alias("h"),
        (F.lit(24.0) + F.when(F.col("l_partkey") % 11 == 0, 0.02).otherwise(0.004 * (F.col("l_partkey") % 3))).alias("fps"),
        F.lit(48000).alias("sample_rate"), F.when(F.col("l_linenumber") == 13, "mono").otherwise("stereo").alias("channels"),
        (F.col("l_tax") < 0.08).alias("has_audio"))


MEDIA_SQL = """md AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS duration, CASE WHEN l_suppkey % 9 = 0 THEN 1920 ELSE 1280 END AS w,
  CASE l_suppkey % 9 WHEN 1 THEN 960 WHEN 0 THEN 1080 ELSE 720 END AS h, CAST(24.0 AS DOUBLE) + CASE WHEN l_partkey % 11 = 0 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.004 AS DOUBLE) * (l_partkey % 3) END AS fps,
  CASE WHEN l_linenumber = 13 THEN 'mono' ELSE 'stereo' END AS channels, l_tax < 0.08 AS has_audio,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)"""


@query("media_consistency", f"""WITH {MEDIA_SQL}, f AS (SELECT l_orderkey, arg_min(fps, seq) AS f0, arg_min(w, seq) AS w0, arg_min(h, seq) AS h0,
   arg_min(w, seq) FILTER (abs(w / h - 16.0::DOUBLE / 9) < 0.1) AS ww, arg_min(h, seq) FILTER (abs(w / h - 16.0::DOUBLE / 9) < 0.1) AS wh FROM md GROUP BY 1)
SELECT md.l_orderkey, count(*) AS clips, bool_and(md.w = w0 AND md.h = h0 AND abs(fps - f0) < 0.01 AND has_audio) AND count(DISTINCT channels) = 1 AS consistent,
  CAST(coalesce(any_value(ww), any_value(w0)) AS INT) AS canvas_w, CAST(coalesce(any_value(wh), any_value(h0)) AS INT) AS canvas_h FROM md JOIN f USING (l_orderkey) GROUP BY 1""")
def media_consistency(t):
    return ag.media_consistency(media_of_panels(t), ["l_orderkey"], PANEL_ORDER)


@query("strict_success", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS ok, count(*) AS units, count(*) FILTER (o_orderstatus <> 'F') AS open_units FROM orders GROUP BY 1")
def strict_success(t):
    return ag.strict_success(_order_units(t), ["o_custkey"], "status")


@query("lenient_success", "SELECT o_custkey, bool_or(o_orderstatus IN ('F', 'P')) AS ok, count(*) AS units, count(*) FILTER (o_orderstatus <> 'F') AS open_units FROM orders GROUP BY 1")
def lenient_success(t):
    return ag.strict_success(_order_units(t), ["o_custkey"], "status", lenient=True)


def _order_units(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_custkey", F.when(s == "F", "completed").when(s == "P", "needs_review").otherwise("pending").alias("status"))


@query("call_accounting", """SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'click')) AS ok_calls, count(*) FILTER (event_type = 'error') AS failed_attempts,
  coalesce(CAST(sum(CAST(event_id % 97 + 0.5 AS DECIMAL(18,3))) FILTER (event_type NOT IN ('error', 'click')) AS DOUBLE), NULL) / greatest(count(*) FILTER (event_type NOT IN ('error', 'click')), 1) AS mean_ok_seconds
FROM events GROUP BY 1""")
def call_accounting(t):
    from ..sources.documents import parse_log_lines
    return ag.call_accounting(parse_log_lines(log_lines(t), "line"), ["user_id"])
