"""Queries on segments, assembly, ledger and telemetry."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import aggregates as ag, assembly as asm, ledger as lg, segments as sg
from ..session import cut_lineage
from .join_queries import STAGE_LEDGER_SQL, stage_ledger
from .registry import query
from .views import PANEL_ORDER, STATES_SQL, entity_states, panel_blocks

_O = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_CENTS = "CAST(round(CAST({} AS DECIMAL(18,6)), 2) AS DOUBLE)"


def _used_units(t):
    """Segments of a customer's orders, with repeats and unknown units."""
    c = F.col
    o = t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("unit"), c("o_totalprice"))
    listed = o.select("k", (F.floor(c("unit") / 1000)).alias("seg"), c("unit").alias("pos"), F.when(c("unit") % 9 == 0, -c("unit")).otherwise(c("unit")).alias("unit"),
                      F.when(F.floor(c("unit") / 1000) % 4 != 0, F.floor(c("unit") / 1000) + 7.5).cast("double").alias("duration"))
    again = o.where("unit % 31 = 0").select("k", F.lit(99).cast("bigint").alias("seg"), c("unit").alias("pos"), "unit", F.lit(12.0).alias("duration"))
    return listed.unionByName(again), o.select("k", "unit")


_USED_SQL = """u AS (SELECT o_custkey AS k, o_orderkey // 1000 AS seg, o_orderkey AS pos, CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey ELSE o_orderkey END AS unit,
   CASE WHEN o_orderkey // 1000 % 4 <> 0 THEN CAST(o_orderkey // 1000 + 7.5 AS DOUBLE) END AS duration FROM orders
   UNION ALL SELECT o_custkey, 99, o_orderkey, o_orderkey, 12.0 FROM orders WHERE o_orderkey % 31 = 0),
kept AS (SELECT k, unit, arg_min(seg, (seg, pos)) AS seg, arg_min(pos, (seg, pos)) AS pos FROM u WHERE unit IN (SELECT o_orderkey FROM orders WHERE o_custkey = k) GROUP BY 1, 2),
tot AS (SELECT k, seg, count(*) AS total, max(duration) AS d FROM u GROUP BY 1, 2), n AS (SELECT k, seg, count(*) AS n_units FROM kept GROUP BY 1, 2)"""


@query("salvage_segments", f"WITH {_USED_SQL} SELECT k, seg, n_units, {_CENTS.format('CASE WHEN coalesce(d, 0) = 0 THEN total * CAST(5 AS DOUBLE) ELSE d END * n_units / total')} AS duration FROM n JOIN tot USING (k, seg)")
def salvage_segments(t):
    return sg.salvage_segments(*_used_units(t), ["k"], "seg", "pos", "unit", "duration")[0]


@query("salvaged_units", f"WITH {_USED_SQL} SELECT k, seg, pos, unit FROM kept")
def salvaged_units(t):
    return sg.salvage_segments(*_used_units(t), ["k"], "seg", "pos", "unit", "duration")[1]


@query("pack_sequential", f"""SELECT l_orderkey, {_O}, (r - 1) // 3 + 1 AS seg, CAST((r - 1) % 3 + 1 AS INT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_O}) AS r FROM lineitem)""")
def pack_sequential(t):
    return sg.pack_sequential(t.lineitem.select("l_orderkey", *PANEL_ORDER), ["l_orderkey"], PANEL_ORDER, 5, 15, panel_blocks())


@query("half_split", f"""
WITH RECURSIVE s AS (SELECT o_orderkey, o_custkey % 13 + 1 AS n, 0::BIGINT AS f, CAST(o_totalprice / 5000 AS DOUBLE) AS d FROM orders
  UNION ALL SELECT o_orderkey, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END, CASE WHEN side = 0 THEN f ELSE f + n // 2 END,
    {_CENTS.format('d * CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END / n')} FROM s, (SELECT unnest([0, 1]) AS side) WHERE d > 15 AND n >= 2)
SELECT o_orderkey, f AS part_from, n AS part_units, least(greatest(d, 1.0), 15.0) AS part_seconds FROM s WHERE NOT (d > 15 AND n >= 2)""")
def half_split(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 13 + 1).alias("n"), (F.col("o_totalprice") / 5000).alias("d"))
    return sg.half_split(o, ["o_orderkey"], "n", "d").drop("n", "d")


def _proposed(t):
    """Proposed segments of a customer's orders: those of every third customer are right, the others name unknown
    orders or name some twice."""
    c, seg = F.col, F.floor(F.col("unit") / 20000)
    o = t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("unit"))
    listed = o.select("k", seg.alias("seg"), c("unit").alias("pos"), F.when((c("k") % 3 != 0) & (c("unit") % 9 == 0), -c("unit")).otherwise(c("unit")).alias("unit"),
                      F.when(seg % 4 != 3, seg * 9 + 7.5).cast("double").alias("duration"), F.when(seg % 5 != 2, F.concat(F.lit("beat "), seg.cast("string"))).alias("beat"))
    again = o.where("k % 3 = 1 AND unit % 31 = 0").select("k", F.lit(9999).cast("bigint").alias("seg"), c("unit").alias("pos"), "unit", F.lit(12.0).alias("duration"), F.lit(" ").alias("beat"))
    return listed.unionByName(again), o


_FINAL_SQL = f"""WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS unit FROM orders),
u AS (SELECT k, unit // 20000 AS seg, unit AS pos, CASE WHEN k % 3 <> 0 AND unit % 9 = 0 THEN -unit ELSE unit END AS unit, CASE WHEN unit // 20000 % 4 <> 3 THEN CAST(unit // 20000 * 9 + 7.5 AS DOUBLE) END AS d FROM o
   UNION ALL SELECT k, 9999, unit, unit, 12.0 FROM o WHERE k % 3 = 1 AND unit % 31 = 0),
kept AS (SELECT u.k, u.unit, arg_min(seg, (seg, pos)) AS seg, arg_min(pos, (seg, pos)) AS pos FROM u JOIN o USING (k, unit) GROUP BY 1, 2),
tot AS (SELECT k, seg, count(*) AS total, max(d) AS d FROM u GROUP BY 1, 2), n AS (SELECT k, seg, count(*) AS n FROM kept GROUP BY 1, 2),
w AS (SELECT k, unit, row_number() OVER (PARTITION BY k ORDER BY unit) AS rn FROM o), p AS (SELECT k, unit, seg, row_number() OVER (PARTITION BY k ORDER BY seg, pos) AS place FROM kept),
ok AS (SELECT w.k FROM w LEFT JOIN p USING (k, unit) GROUP BY w.k HAVING bool_and(coalesce(place = rn, false))),
s0 AS (SELECT k, seg, n, {_CENTS.format('CASE WHEN coalesce(d, 0) = 0 THEN total * CAST(5 AS DOUBLE) ELSE d END * n / total')} AS d,
   CASE WHEN seg % 5 <> 2 AND seg < 9999 THEN 'beat ' || seg ELSE '{fixed.FALLBACK_BEAT}' END AS beat, 'salvaged' AS how, (SELECT min(place) FROM p WHERE p.k = n.k AND p.seg = n.seg) AS a FROM n JOIN tot USING (k, seg) SEMI JOIN ok USING (k)
   UNION ALL SELECT k, (rn - 1) // 3 + 1, count(*), 5.0 * count(*), '{fixed.FALLBACK_BEAT}', 'packed', min(rn) FROM w ANTI JOIN ok USING (k) GROUP BY 1, 2),
s AS (SELECT k, seg, a AS f, n, CAST(d AS DOUBLE) AS d, beat, how FROM s0
   UNION ALL SELECT k, seg, CASE WHEN side = 0 THEN f ELSE f + n // 2 END, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END, {_CENTS.format('d * CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END / n')}, beat, how
   FROM s, (SELECT unnest([0, 1]) AS side) WHERE d > 15 AND n >= 2),
done AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS no FROM s WHERE NOT (d > 15 AND n >= 2))"""


@query("final_segments", f"{_FINAL_SQL} SELECT k, no AS seg, n AS n_units, least(greatest(d, 1.0), 15.0) AS duration, beat, how FROM done")
def final_segments(t):
    used, units = _proposed(t)
    return sg.final_segments(used, units, ["k"], "seg", "pos", "unit", ["unit"], "duration", "beat")[0]


@query("final_segment_units", f"{_FINAL_SQL} SELECT done.k, no AS seg, CAST(rn - f + 1 AS INT) AS pos, unit FROM done JOIN w ON w.k = done.k AND rn >= f AND rn < f + n")
def final_segment_units(t):
    used, units = _proposed(t)
    return sg.final_segments(used, units, ["k"], "seg", "pos", "unit", ["unit"], "duration", "beat")[1]


@query("explode_attempts", """SELECT doc_id, attempt, CAST('0x' || substr(md5('run1:' || doc_id), 1, 8) AS BIGINT) + attempt * 7919 AS attempt_seed
FROM documents, (SELECT unnest([0, 1, 2]) AS attempt)""")
def explode_attempts(t):
    from ..functions.seeds import seed32
    d = t.documents.select("doc_id", seed32(F.concat(F.lit("run1:"), F.col("doc_id").cast("string"))).alias("seed"))
    return sg.explode_attempts(d, "seed").drop("seed")


def entity_dim(t):
    c = F.col
    sex = F.when(c("p_type").isin("ECONOMY", "SMALL"), "female").when(c("p_type") == "LARGE", "male").otherwise("-")
    return t.part.select(c("p_partkey").alias("entity"), F.concat("p_brand", F.lit(", 红发")).alias("anchor"), F.replace("p_name", F.lit(" "), F.lit(", ")).alias("tags"), sex.alias("gender"))


def mentions(t):
    return t.lineitem.select(F.col("l_orderkey").alias("panel"), *[c for c in PANEL_ORDER], F.col("l_partkey").alias("entity"), (F.col("l_linenumber") * 8).alias("page"))


def resolved(t):
    st = entity_states(t).withColumn("state_tags", F.concat(F.lit("coat "), F.col("lo").cast("string")))
    return asm.resolve_entities(mentions(t), entity_dim(t), st, "entity", "page", ["state_tags"]).withColumn("state_tags", F.coalesce("state_state_tags", F.lit("")))


_RESOLVED_SQL = f"""{STATES_SQL}, mn AS (SELECT l_orderkey AS panel, {_O}, l_partkey AS entity, l_linenumber * 8 AS page FROM lineitem),
hit AS (SELECT d.entity, d.page, arg_max(st.lo, st.ord) AS lo FROM (SELECT DISTINCT entity, page FROM mn) d JOIN st ON st.entity = d.entity AND d.page BETWEEN st.lo AND st.hi GROUP BY 1, 2),
rs AS (SELECT mn.*, p_brand AS anchor, replace(p_name, ' ', ', ') AS tags, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'female' WHEN p_type = 'LARGE' THEN 'male' ELSE '-' END AS gender,
  coalesce('coat ' || hit.lo, '') AS state_tags FROM mn JOIN part ON p_partkey = mn.entity LEFT JOIN hit ON hit.entity = mn.entity AND hit.page = mn.page)"""


@query("resolve_entities", f"WITH {_RESOLVED_SQL} SELECT panel, {_O}, anchor, tags, gender, state_tags FROM rs")
def resolve_entities(t):
    return resolved(t).select("panel", *PANEL_ORDER, "anchor", "tags", "gender", "state_tags")


@query("assemble_prompts", f"""WITH {_RESOLVED_SQL},
a AS (SELECT panel, string_agg(concat_ws(', ', nullif(anchor, ''), nullif(tags, ''), nullif(state_tags, '')), ', ' ORDER BY {_O}) AS blocks, string_agg(nullif(anchor, ''), '|' ORDER BY {_O}) AS anchors, string_agg(entity, '|' ORDER BY {_O}) AS characters, count(*) FILTER (gender = 'female') AS f, count(*) FILTER (gender = 'male') AS m FROM rs GROUP BY 1),
b AS (SELECT o_orderkey AS panel, o_custkey % 40 AS page, blocks, anchors, characters, coalesce(f, 0) AS f, coalesce(m, 0) AS m, o_orderpriority AS scene, 600 + o_custkey % 900 AS cw FROM orders LEFT JOIN a ON a.panel = o_orderkey),
c AS (SELECT *, CASE WHEN f = 0 AND m = 0 THEN 'no humans' ELSE concat_ws(', ', CASE WHEN f = 1 THEN '1girl' WHEN f > 1 THEN f || 'girls' END, CASE WHEN m = 1 THEN '1boy' WHEN m > 1 THEN m || 'boys' END) END AS ct,
  CASE WHEN cw / 1000 < 0.8 THEN 'vertical' WHEN cw / 1000 > 1.25 THEN 'horizontal' ELSE 'square' END AS bk FROM b)
SELECT panel, page, coalesce(anchors, '') AS anchors, coalesce(characters, '') AS characters, scene AS scene_tags, ',masterpiece,best quality,' AS quality_tail, round(cw / 1000, 4) AS crop_aspect, ct AS count_tag, concat_ws(', ', ct, blocks, scene) || ',masterpiece,best quality,' AS positive,
  concat_ws(', ', CASE WHEN f > 0 AND m = 0 THEN '{", ".join(fixed.EXCLUDE_WHEN_FEMALE)}' WHEN m > 0 AND f = 0 THEN '{", ".join(fixed.EXCLUDE_WHEN_MALE)}' END, 'lowres') AS negative_text,
  bk AS size_bucket, CASE bk WHEN 'vertical' THEN 1024 WHEN 'horizontal' THEN 1408 ELSE 1216 END AS width, CASE bk WHEN 'vertical' THEN 1408 WHEN 'horizontal' THEN 1024 ELSE 1216 END AS height,
  CAST('0x' || substr(md5('run1:' || panel), 1, 8) AS BIGINT) AS seed FROM c""")
def assemble_prompts(t):
    panels = t.orders.select(F.col("o_orderkey").alias("panel"), F.concat("o_orderpriority", F.lit(", ")).alias("scene"), F.lit("").alias("tail"), F.lit("lowres").alias("negative"),
                             (600 + F.col("o_custkey") % 900).alias("crop_w"), F.lit(1000).alias("crop_h"), (F.col("o_custkey") % 40).alias("page"))
    cast = cut_lineage(resolved(t))  # read again to look for large panels
    made = asm.assemble_prompts(panels, cast, "panel", PANEL_ORDER, "run1", entity="entity", carry=["page"], blocks=panel_blocks())
    return made.withColumns({c: F.array_join(c, "|") for c in ("anchors", "characters")})


@query("entity_cards", """SELECT s_nationkey, CAST(0 AS BIGINT) AS part, string_agg('### ' || s_name || '（' || CASE WHEN s_suppkey % 3 = 0 THEN 'female' ELSE 'unknown' END || '）' || chr(10) || '- ' || n_name || chr(10) || '- ' ||
  CASE WHEN s_acctbal < 0 THEN '（未定义）' ELSE 'state ' || s_suppkey END, chr(10) ORDER BY s_suppkey) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def entity_cards(t):
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    card = asm.entity_card(F.col("s_name"), F.when(F.col("s_suppkey") % 3 == 0, "Girl"), F.col("n_name"), F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("state "), F.col("s_suppkey").cast("string"))))
    return asm.roster_text(s, ["s_nationkey"], ["s_suppkey"], card)


@query("media_from_logs", """SELECT l_orderkey, l_linenumber, l_partkey, 60.0 + l_quantity + 0.25 AS duration, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 1280 END AS w, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 720 END AS h,
  CASE l_partkey % 3 WHEN 0 THEN 23.98 WHEN 1 THEN 25.0 ELSE 24.0 END::DOUBLE AS fps, CASE WHEN l_linenumber > 3 THEN 44100 ELSE 48000 END AS sample_rate, CASE WHEN l_linenumber > 3 THEN 'mono' ELSE 'stereo' END AS channels, l_linenumber > 3 AS has_audio FROM lineitem""")
def media_from_logs(t):
    c, p = F.col, F.lit
    log = F.concat(
        p("Duration: 00:01:"), F.lpad(c("l_quantity").cast("int").cast("string"), 2, "0"), p(".25, start: 0\n"),
        F.when(c("l_suppkey") % 4 == 0, p("Stream none\n")).otherwise(p("Stream #0 Video: h264 (High), yuv420p, 1280x720, ")),
        F.when(c("l_partkey") % 3 == 0, p("23.98 fps, 24 tbr\n")).when(c("l_partkey") % 3 == 1, p("25 tbr\n")).otherwise(p("\n")),
        F.when(c("l_linenumber") > 3, p("Audio: aac, 44100 Hz, mono, fltp")).otherwise(p("")))
    return asm.media_from_logs(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", log.alias("log")), "log").drop("log")


def _item_events(t):
    c = F.col
    stage = F.concat(F.lit("s"), (c("event_id") % 4).cast("string"))
    status = F.when(c("event_type").isin("click", "view"), "completed").when(c("event_type") == "error", "failed").when(c("event_type") == "signup", "needs_review").otherwise("in_progress")
    return t.events.select((c("user_id") % 20).alias("run"), stage.alias("stage"), (c("event_id") % 37).alias("item"), status.alias("status"), "props", F.when(c("event_type") == "error", F.concat(F.lit("n"), c("event_id").cast("string"))).alias("note"), "ts", "event_id")


_ITEMS_SQL = """it AS (SELECT user_id % 20 AS run, 's' || event_id % 4 AS stage, event_id % 37 AS item, CASE WHEN event_type IN ('click', 'view') THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'needs_review' ELSE 'in_progress' END AS status,
  props, CASE WHEN event_type = 'error' THEN 'n' || event_id END AS note, ts, event_id FROM events),
led AS (SELECT run, stage, item, arg_max(status, (ts, event_id)) AS status, arg_max(props, (ts, event_id)) AS data, arg_max(note, (ts, event_id)) FILTER (note IS NOT NULL) AS note, max(ts) AS ts FROM it GROUP BY 1, 2, 3)"""


def item_ledger(t):
    d = _item_events(t).withColumnRenamed("props", "data")
    return lg.upsert_ledger(d.where("event_id % 3 <> 0"), d.where("event_id % 3 = 0"), ["run", "stage", "item"], ["ts", "event_id"])


@query("upsert_ledger", f"WITH {_ITEMS_SQL} SELECT * FROM led")
def upsert_ledger(t):
    return item_ledger(t).drop("event_id")


@query("stage_outcome", f"""WITH {_ITEMS_SQL}, g AS (SELECT run, stage, count(*) AS n, count(*) FILTER (status <> 'completed') AS o FROM led GROUP BY 1, 2)
SELECT run, stage, CASE WHEN o = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o > 0 THEN o || ' of ' || n || ' not completed' END AS note FROM g""")
def stage_outcome(t):
    return lg.stage_outcome(item_ledger(t), ["run", "stage"], "status")


@query("run_report", f"WITH {_ITEMS_SQL} SELECT stage, bool_and(status = 'completed') AS ok, count(*) AS units, count(*) FILTER (status <> 'completed') AS open_units FROM led GROUP BY 1")
def run_report(t):
    return lg.run_report(item_ledger(t), ["stage"], "item", "status")[0]


@query("run_report_open", f"WITH {_ITEMS_SQL} SELECT run, stage, item, status FROM led WHERE status <> 'completed'")
def run_report_open(t):
    return lg.run_report(item_ledger(t), ["run", "stage"], "item", "status")[1]


@query("retry_cycles", """
WITH c AS (SELECT doc_id, unnest([1, 2, 3]) AS cycle, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE doc_id % 3 + 1 END AS need FROM documents)
SELECT doc_id, CAST(cycle AS INT) AS cycle, CASE WHEN cycle >= need THEN 'completed' ELSE 'failed' END AS status FROM c WHERE cycle <= need""")
def retry_cycles(t):
    def run(units, cycle):
        need = F.when(F.col("doc_id") % 4 == 0, 4).otherwise(F.col("doc_id") % 3 + 1)
        return units.select("doc_id", F.when(F.lit(cycle) >= need, "completed").otherwise("failed").alias("status"), (F.lit(cycle) >= need).alias("ok"))

    return lg.retry_cycles(t.documents.select("doc_id"), ["doc_id"], run, 3)[0].drop("ok")


@query("telemetry_snapshot", """
SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type IN ('click', 'view')) AS busy, count(*) AS total, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') AS n_signup,
  CAST(least(count(*) FILTER (event_type IN ('click', 'view')), 8) * 100.0 / 8 AS DOUBLE) AS utilisation_pct, greatest(count(*) FILTER (event_type IN ('click', 'view')) - 8, 0) AS queued FROM events GROUP BY 1""")
def telemetry_snapshot(t):
    d = t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    out = lg.telemetry_snapshot(d, ["hour"], F.col("event_type").isin("click", "view"), 8, "event_type", ["error", "signup"])
    return out.withColumn("utilisation_pct", F.col("utilisation_pct").cast("double"))
