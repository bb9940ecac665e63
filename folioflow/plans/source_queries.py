"""Queries on sources: assets, logs, ledgers, reports."""

from pyspark.sql import functions as F

from ..sources import assets, documents, sinks
from .registry import query


def _asset_paths(t):
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/$", "")
    m = F.col("page_id") % 6
    ext = F.when(m == 0, ".png").when(m == 1, ".JPG").when(m == 2, ".webp").when(m == 3, ".txt").when(m == 4, "-05.jpeg").otherwise("")
    return t.pages.select("page_id", F.concat(path, ext).alias("path"))


_ASSETS_SQL = r"""a AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/$', '') ||
   CASE page_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.txt' WHEN 4 THEN '-05.jpeg' ELSE '' END AS path FROM pages),
b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file FROM a),
c AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_extract(file, '\.([^.]+)$', 1)) AS ext,
   TRY_CAST(regexp_extract(regexp_replace(file, '\.[^.]*$', ''), '(\d+)\D*$', 1) AS BIGINT) AS number FROM b),
assets AS (SELECT * FROM c WHERE ext IN ('png', 'jpg', 'jpeg', 'webp') AND number IS NOT NULL)"""


@query("numbered_assets", f"WITH {_ASSETS_SQL} SELECT page_id, path, file, dir, ext, number FROM assets")
def numbered_assets(t):
    return assets.numbered_assets(_asset_paths(t))


@query("pick_asset_root", f"""WITH {_ASSETS_SQL}, d AS (SELECT dir, count(*) AS n, CAST(length(dir) - length(replace(dir, '/', '')) AS INT) AS depth FROM assets GROUP BY 1)
SELECT dir, depth, n FROM d ORDER BY depth DESC, n DESC, dir LIMIT 1""")
def pick_asset_root(t):
    return assets.pick_asset_root(assets.numbered_assets(_asset_paths(t)))


@query("natural_sort", f"WITH {_ASSETS_SQL} SELECT row_number() OVER (ORDER BY number, file, page_id) AS pos, page_id, number, file FROM assets")
def natural_sort(t):
    from ..operators.sorting import natural_order
    a = assets.numbered_assets(_asset_paths(t)).select("page_id", "number", "file")
    return natural_order(a, "number", "file", "page_id")


_LOG_SQL = """lg AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS stamp, ts, event_id % 1000 AS ms,
  CASE event_type WHEN 'error' THEN 'WARNING' ELSE 'INFO' END AS lvl, event_type, user_id, event_id % 97 AS sec FROM events)"""


def log_lines(t):
    """Stage log lines written from the events."""
    n = lambda c: c.cast("string")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad(n(F.col("event_id") % 1000), 3, "0"))
    msg = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("s2 u"), n(F.col("user_id")), F.lit(": attempt 1 failed: no json")))
        .when(F.col("event_type") == "click", F.concat(F.lit("[llm] ttft=0.1s total="), n(F.col("event_id") % 97), F.lit(".5s content="), n(F.col("user_id")),
              F.lit("c reasoning="), n(F.col("event_id") % 13), F.lit("c decode="), n(F.col("event_id") % 97), F.lit(".4s")))
        .otherwise(F.concat(F.lit("s2 u"), n(F.col("user_id")), F.lit(": llm ok in "), n(F.col("event_id") % 97), F.lit(".5s")))
    )
    level = F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO")
    return t.events.select("event_id", "user_id", "event_type", F.concat(stamp, F.lit(" ["), level, F.lit("] "), msg).alias("line"))


@query("parse_log_lines", f"""WITH {_LOG_SQL}
SELECT event_id, date_trunc('second', ts) + ms * INTERVAL 1 MILLISECOND AS log_ts, lvl AS level,
  CASE event_type WHEN 'error' THEN 's2 u' || user_id || ': attempt 1 failed: no json'
    WHEN 'click' THEN '[llm] ttft=0.1s total=' || sec || '.5s content=' || user_id || 'c reasoning=' || event_id % 13 || 'c decode=' || sec || '.4s' ELSE 's2 u' || user_id || ': llm ok in ' || sec || '.5s' END AS message,
  CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(sec + 0.5 AS DOUBLE) END AS ok_seconds, event_type = 'error' AS failed,
  CASE WHEN event_type = 'click' THEN CAST(sec + 0.5 AS DOUBLE) END AS total_seconds,
  CASE WHEN event_type = 'click' THEN CAST(user_id AS INT) END AS content_chars, CASE WHEN event_type = 'click' THEN CAST(0.1 AS DOUBLE) END AS ttft_seconds,
  CASE WHEN event_type = 'click' THEN CAST(sec + 0.4 AS DOUBLE) END AS decode_seconds, CASE WHEN event_type = 'click' THEN CAST(event_id % 13 AS INT) END AS reasoning_chars FROM lg""")
def parse_log_lines(t):
    return documents.parse_log_lines(log_lines(t).select("event_id", "line"), "line").drop("line")


_STITCH_SQL = """st AS (SELECT event_id, user_id % 5 AS file, event_id // 300 AS part, event_type <> 'view' AS starts, event_type FROM events),
r AS (SELECT *, max(CASE WHEN starts THEN event_id END) OVER (PARTITION BY file ORDER BY event_id) AS rec FROM st)"""


def _stitched(t):
    """Views are continuation lines of the record before; files are users modulo 5, parts 300 events."""
    d = log_lines(t).withColumn("line", F.when(F.col("event_type") == "view", F.concat(F.lit("  File "), F.col("event_id").cast("string"))).otherwise(F.col("line")))
    d = d.select((F.col("user_id") % 5).alias("file"), F.floor(F.col("event_id") / 300).alias("part"), "event_id", "line")
    return documents.stitch_log_lines(d, "line", ["file"], "part", "event_id")


@query("stitch_log_records", f"""WITH {_STITCH_SQL}, n AS (SELECT rec, count(*) AS more_lines FROM r WHERE NOT starts GROUP BY rec)
SELECT file, part, event_id, event_type = 'error' AS failed, coalesce(more_lines, 0) AS more_lines FROM r LEFT JOIN n ON n.rec = r.event_id WHERE starts""")
def stitch_log_records(t):
    return _stitched(t)[0].select("file", "part", "event_id", "failed", "more_lines")


@query("stitch_log_rest", f"""WITH {_STITCH_SQL} SELECT file, part, event_id, '  File ' || event_id AS line, rec // 300 AS record_block, rec AS record_ord FROM r WHERE NOT starts""")
def stitch_log_rest(t):
    return _stitched(t)[1]


def ledger_json(t):
    """One run file per order."""
    s = lambda c: F.col(c).cast("string")
    body = F.concat(
        F.lit('{"s0": {"status": "completed", "note": "from '), s("o_custkey"), F.lit('", "items": {"page_01": {"status": "'),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed"), F.lit('", "data": {"panels":'), s("o_custkey"),
        F.lit('}}}}, "s1": {"status": "'), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress"), F.lit('", "items": {}}}'),
    )
    return t.orders.select(F.col("o_orderkey").alias("run_id"), body.alias("stages"))


@query("ledger_rows", """
SELECT o_orderkey AS run_id, 's0' AS stage, NULL::VARCHAR AS item, 'completed' AS status, NULL::VARCHAR AS data, 'from ' || o_custkey AS note FROM orders
UNION ALL SELECT o_orderkey, 's1', NULL, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'in_progress' END, NULL, NULL FROM orders
UNION ALL SELECT o_orderkey, 's0', 'page_01', CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END, '{"panels":' || o_custkey || '}', NULL FROM orders""")
def ledger_rows(t):
    return documents.ledger_rows(ledger_json(t), "stages", ["run_id"])


@query("ledger_errors", """
SELECT o_orderkey AS run_id, CASE o_orderkey % 7 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no stages' WHEN 2 THEN 'no stages' WHEN 3 THEN 'bad stage s0, s1' WHEN 4 THEN 'no stages' END AS error
FROM orders WHERE o_orderkey % 7 < 5""")
def ledger_errors(t):
    m = F.col("run_id") % 7
    text = F.when(m == 0, F.substring("stages", 1, 40)).when(m == 1, "[1, 2]").when(m == 2, F.lit(None).cast("string")).when(
        m == 3, F.regexp_replace("stages", '"status": "(completed|pending|in_progress)", "(note|items)"', '"state": "$1", "$2"')).when(m == 4, "{}").otherwise(F.col("stages"))
    return documents.split_ledger(ledger_json(t).withColumn("stages", text), "stages", ["run_id"])[1].select("run_id", "error")


@query("write_report", """
SELECT CASE WHEN fin > 0 THEN 'unresolved' WHEN ini > 0 THEN 'repaired' ELSE 'pass' END AS verdict, count(*) AS n
FROM (SELECT CASE WHEN n_chars < 500 THEN 1 ELSE 0 END + CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS ini, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS fin FROM documents)
GROUP BY 1""")
def write_report(t):
    ini = F.when(F.col("n_chars") < 500, 1).otherwise(0) + F.when(F.col("lang") != "en", 1).otherwise(0)
    d = t.documents.select("doc_id", ini.alias("ini"), F.when(F.col("lang") == "de", 1).otherwise(0).alias("fin"), F.lit(1).alias("rounds"))
    return sinks.report_lines(d, "doc_id", "ini", "fin", "rounds").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("json_value", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type <> 'error' AS found FROM events""".replace(
    "CAST(json_extract_string(props, '$.k') AS BIGINT)", "CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END"))
def json_value(t):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye")))
        .when(kind == "click", F.concat(F.lit("Sure {not json} then "), "props", F.lit(" and {}")))
        .when(kind == "error", F.lit("no value [here"))
        .otherwise(F.col("props"))
    )
    good, bad = documents.json_value(t.events.select("event_id", raw.alias("raw")), "raw", "k BIGINT")
    return good.select("event_id", F.col("record.k").alias("k"), F.lit(True).alias("found")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("found")))
