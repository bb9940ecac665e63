"""Queries on user functions and streams."""

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..session import scratch_folder
from ..streaming import keyed, streams as st
from .aggregate_queries import ATTEMPTS_SQL
from .registry import query
from .section_queries import _SECTIONS_SQL
from .views import scripts

@query("enrich", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE upper(lang) || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END END AS label,
  CAST(CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts, doc_id % 7 <> 0 AS good FROM documents""")
def enrich(t):
    def call(rows, errors):
        label = rows["lang"].str.upper()
        second = errors != ""
        label = label.where(~(second & (rows["doc_id"] % 3 == 0)), label + "!")
        bad = (rows["doc_id"] % 7 == 0) | ((rows["doc_id"] % 3 == 0) & ~second)
        return label.mask(bad, "").to_frame("label")

    def validate(out):
        return out["label"].map(lambda s: [] if s else ["label blank"])

    good, bad = en.enrich(t.documents.select("doc_id", "lang"), call, "label string", validate, lanes=4)
    return good.select("doc_id", "label", "attempts", F.lit(True).alias("good")).unionByName(
        bad.select("doc_id", F.lit(None).cast("string").alias("label"), "attempts", F.lit(False).alias("good")))


@query("sequential_chain", """
WITH RECURSIVE r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, md5(text) AS digest FROM r WHERE n = 1
  UNION ALL SELECT r.conv_id, r.turn, r.n, md5(c.digest || r.text) FROM c JOIN r ON r.conv_id = c.conv_id AND r.n = c.n + 1)
SELECT conv_id, turn, digest FROM c""")
def sequential_chain(t):
    def step(last, row):
        import hashlib
        return hashlib.md5(((last or "") + row["text"]).encode()).hexdigest()

    return en.sequential_chain(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], step, "digest").drop("text")


@query("sections_function", f"WITH {_SECTIONS_SQL} SELECT doc_id, ord, heading, body FROM secs")
def sections_function(t):
    en.register_sections(t.spark, "folio_sections")
    return t.spark.sql("SELECT d.doc_id, s.ord, s.heading, s.body FROM {docs} d, LATERAL folio_sections(d.text) s", docs=scripts(t))


def _event_stream(t):
    # a pattern, so that both one file and a folder of files can be read as a stream
    d = st.stream_units(t.spark, f"{t.folder}/[e]vents.parquet", t.events.schema)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_units", "SELECT event_id, event_type, value FROM events")
def stream_units(t):
    return st.run_to_table(_event_stream(t).select("event_id", "event_type", "value"), "units")


@query("stream_final_units", """
WITH e AS (SELECT event_id % 50 AS run, CASE WHEN event_type = 'error' AND value > 97 THEN NULL ELSE event_id // 50 % 40 END AS unit, event_type FROM events),
u AS (SELECT run, unit, unit % 3 AS lines, bool_or(event_type IN ('purchase', 'signup')) AS final FROM e WHERE unit IS NOT NULL GROUP BY run, unit),
d AS (SELECT DISTINCT run FROM e WHERE unit IS NULL)
SELECT run, unit, lines, CASE WHEN lines = 0 THEN 'complete' ELSE 'process' END AS action, NOT final AS swept FROM u WHERE final OR run IN (SELECT run FROM d)""")
def stream_final_units(t):
    kind = F.col("event_type")
    whole = (kind == "error") & (F.col("value") > 97)
    status = F.when(kind == "purchase", "completed").when(kind == "signup", "needs_review").when(whole, "failed").otherwise("pending")
    unit = F.when(~whole, F.floor(F.col("event_id") / 50) % 40)
    led = _event_stream(t).select((F.col("event_id") % 50).alias("run"), unit.alias("unit"), status.alias("status"), (unit % 3).alias("lines"), "ts")
    folder = scratch_folder(t.spark, "final")
    st.stream_final_units(led, "run", "unit", "status", "lines", "ts", f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("run", "unit", "lines", "action", "swept")


# a key is a user on one day; the earliest input of the key counts, also one from before the segment
_PAIR_SQL = """WITH e AS (SELECT *, user_id * 100 + day(ts) AS k FROM events), s AS (SELECT event_id AS seg_id, k, ts AS seg_ts FROM e WHERE event_type = 'signup'),
f AS (SELECT k, min(ts) AS frame_ts FROM e WHERE event_type = 'view' GROUP BY k), p AS (SELECT k, min(ts) AS prompt_ts FROM e WHERE event_type = 'click' GROUP BY k)
"""


def _pair(t):
    k = (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("k")
    kind = lambda name, *cols: _event_stream(t).where(F.col("event_type") == name).select(k, *cols)
    segs = kind("signup", F.col("event_id").alias("seg_id"), F.col("ts").alias("seg_ts"))
    return segs, kind("click", F.col("ts").alias("prompt_ts")), kind("view", F.col("ts").alias("frame_ts"))


@query("stream_match_frames", _PAIR_SQL + """SELECT seg_id, s.k, seg_ts, frame_ts, CASE WHEN frame_ts IS NULL THEN 't2va' ELSE 'i2va' END AS mode
FROM s LEFT JOIN f ON f.k = s.k AND frame_ts <= seg_ts + INTERVAL 30 MINUTE""")
def stream_match_frames(t):
    segs, _, frames = _pair(t)
    return _plain(st.run_to_table(st.match_frames(segs, frames, "k", "seg_id", "seg_ts", "frame_ts", ended=(t.events, "ts")), "frames"), "seg_ts", "frame_ts")


@query("stream_match_prompts", _PAIR_SQL + """SELECT seg_id, s.k, seg_ts, prompt_ts, CASE WHEN prompt_ts IS NULL THEN 'failed' ELSE 'ready' END AS status
FROM s LEFT JOIN p ON p.k = s.k AND prompt_ts <= seg_ts + INTERVAL 60 MINUTE""")
def stream_match_prompts(t):
    segs, prompts, _ = _pair(t)
    return _plain(st.run_to_table(st.match_prompts(segs, prompts, "k", "seg_id", "seg_ts", "prompt_ts", ended=(t.events, "ts")), "prompts"), "seg_ts", "prompt_ts")


@query("stream_match_inputs", _PAIR_SQL + """SELECT seg_id, m.k, seg_ts, prompt_ts, frame_ts, CASE WHEN prompt_ts IS NULL THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN prompt_ts IS NULL THEN NULL WHEN frame_ts IS NULL THEN 't2va' ELSE 'i2va' END AS mode
FROM (SELECT s.*, prompt_ts FROM s LEFT JOIN p ON p.k = s.k AND prompt_ts <= seg_ts + INTERVAL 60 MINUTE) m
LEFT JOIN f ON f.k = m.k AND frame_ts <= greatest(seg_ts, prompt_ts) + INTERVAL 30 MINUTE AND prompt_ts IS NOT NULL""")
def stream_match_inputs(t):
    d = st.match_inputs(*_pair(t), "k", "seg_id", "seg_ts", "prompt_ts", "frame_ts", ended=(t.events, "ts"))
    return _plain(st.run_to_table(d, "inputs"), "seg_ts", "prompt_ts", "frame_ts")


@query("stream_latest_writes", """
SELECT user_id % 100 AS run, event_type AS stage, event_id % 7 AS item, max_by(value, struct_pack(v := value, i := event_id)) AS value, max(struct_pack(v := value, i := event_id)).i AS event_id,
  max_by(props, struct_pack(v := value, i := event_id)) AS data FROM events GROUP BY ALL""")
def stream_latest_writes(t):
    # the order of writes is not that of arrival
    d = _event_stream(t).select((F.col("user_id") % 100).alias("run"), F.col("event_type").alias("stage"), (F.col("event_id") % 7).alias("item"), "value", "event_id", F.col("props").alias("data"))
    keys = ["run", "stage", "item"]
    return keyed.current_writes(st.run_to_table(keyed.latest_writes(d, keys, ["value", "event_id"], ["data"]), "latest"), keys)


@query("stream_retry_machine", f"""WITH {ATTEMPTS_SQL},
r AS (SELECT *, CASE WHEN infra THEN 'f' WHEN passed AND score >= 7 THEN 'a' ELSE 'r' END AS c, row_number() OVER (PARTITION BY unit ORDER BY attempt) AS n FROM att),
e AS (SELECT *, count(*) FILTER (c IN ('f', 'a')) OVER (PARTITION BY unit ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM r)
SELECT unit, attempt, CAST(CASE WHEN c = 'f' THEN n - 1 ELSE n END AS INT) AS used, CASE WHEN c = 'f' THEN 'failed' WHEN c = 'a' THEN 'completed' WHEN n >= 3 THEN 'needs_review' ELSE 'retry' END AS action FROM e WHERE closed = 0""")
def stream_retry_machine(t):
    from ..functions.seeds import score
    c = F.col
    d = _event_stream(t).select(
        F.floor(c("event_id") / 3).alias("unit"), (c("event_id") % 3).cast("int").alias("attempt"), (c("event_type") != "error").alias("passed"),
        score(F.when(c("event_type") == "view", "n/a").otherwise(c("value").cast("int").cast("string"))).alias("points"),
        ((c("event_type") == "signup") & (c("value") > 80)).alias("infra"))
    return st.run_to_table(st.retry_machine(d, "unit", "attempt", "passed", "points", "infra"), "retry")


_TELEMETRY_SQL = """SELECT start, start + INTERVAL 10 SECOND AS "end", busy, total, CAST(least(busy, 4) * 100.0 / 4 AS DOUBLE) AS utilisation_pct FROM (
  SELECT {start} AS start, count(*) FILTER (event_type IN ('click', 'view')) AS busy, count(*) AS total FROM {rows} GROUP BY 1)"""


def _telemetry(t, slide=None):
    stream = keyed.with_closing(_event_stream(t), "ts", t.events, "1 hour")
    d = st.telemetry_windows(stream, "ts", F.col("event_type").isin("click", "view"), 4, slide=slide)
    return _plain(st.run_to_table(d, "telemetry"), "start", "end")


@query("stream_telemetry", _TELEMETRY_SQL.format(start="time_bucket(INTERVAL 10 SECOND, ts)", rows="events"))
def stream_telemetry(t):
    return _telemetry(t)


@query("stream_telemetry_sliding", _TELEMETRY_SQL.format(
    start="s", rows="(SELECT *, unnest([time_bucket(INTERVAL 5 SECOND, ts), time_bucket(INTERVAL 5 SECOND, ts) - INTERVAL 5 SECOND]) AS s FROM events)"))
def stream_telemetry_sliding(t):
    return _telemetry(t, "5 seconds")


@query("stream_sessions", """
WITH s AS (SELECT event_type, ts, value FROM events WHERE value >= 40),
g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM s),
k AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts) AS sid FROM g)
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS calls, max(value) AS slowest FROM k GROUP BY event_type, sid""")
def stream_sessions(t):
    stream = keyed.with_closing(_event_stream(t).select("event_type", "ts", "value"), "ts", t.events, "2 hours")
    return _plain(st.run_to_table(st.slow_sessions(stream, "ts", ["event_type"], "value", 40.0), "sessions"), "start", "end")


@query("stream_dedupe_updates", "SELECT DISTINCT event_id // 2 AS unit FROM events")
def stream_dedupe_updates(t):
    d = _event_stream(t).select(F.floor(F.col("event_id") / 2).alias("unit"), "ts")
    return st.run_to_table(st.dedupe_updates(d, "ts", ["unit"]), "dedupe").select("unit")
