"""Queries on states, ranges and gaps."""

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..session import cut_lineage
from .registry import query
from .views import STATES_SQL, entity_states


def _states(t):
    """The states are derived by a grouping and read several times, so they are stored once."""
    return cut_lineage(entity_states(t))


def _facts(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("entity"), (F.col("l_linenumber") * 8).alias("pos")
    )


def _required(t):
    return t.lineitem.select((F.col("l_linenumber") * 8).alias("pos")).distinct()


_FACTS_SQL = "f AS (SELECT l_orderkey, l_linenumber, l_partkey AS entity, l_linenumber * 8 AS pos FROM lineitem)"


@query("state_at_latest_listed", f"""
WITH {STATES_SQL}, {_FACTS_SQL},
p AS (SELECT d.entity, d.pos, max(st.ord) AS state_ord
      FROM (SELECT DISTINCT entity, pos FROM f) d
      LEFT JOIN st ON st.entity = d.entity AND d.pos BETWEEN st.lo AND st.hi GROUP BY 1, 2)
SELECT f.l_orderkey, f.l_linenumber, f.entity, f.pos, p.state_ord
FROM f JOIN p ON f.entity = p.entity AND f.pos = p.pos""")
def state_at_latest_listed(t):
    return iv.state_at(_facts(t), entity_states(t), ["entity"], "pos", policy="latest_listed")


@query("state_at_earliest_start", f"""
WITH {STATES_SQL}, {_FACTS_SQL},
p AS (SELECT * FROM (
        SELECT d.entity, d.pos, st.ord AS state_ord, st.lo AS state_lo,
               row_number() OVER (PARTITION BY d.entity, d.pos ORDER BY st.lo, st.hi, st.ord) AS r
        FROM (SELECT DISTINCT entity, pos FROM f) d
        LEFT JOIN st ON st.entity = d.entity AND d.pos BETWEEN st.lo AND st.hi) WHERE r = 1)
SELECT f.l_orderkey, f.l_linenumber, f.entity, f.pos, p.state_ord, p.state_lo
FROM f JOIN p ON f.entity = p.entity AND f.pos = p.pos""")
def state_at_earliest_start(t):
    return iv.state_at(_facts(t), entity_states(t), ["entity"], "pos", payload=["lo"], policy="earliest_start")


@query("state_at_or_all", f"""
WITH {STATES_SQL}, {_FACTS_SQL}, d AS (SELECT DISTINCT entity, pos FROM f),
hit AS (SELECT d.entity, d.pos, st.ord, st.lo, st.hi FROM d JOIN st
        ON st.entity = d.entity AND d.pos BETWEEN st.lo AND st.hi)
SELECT entity, pos, ord, lo, hi, true AS covered FROM hit
UNION ALL
SELECT d.entity, d.pos, st.ord, st.lo, st.hi, false FROM d JOIN st ON st.entity = d.entity
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.entity = d.entity AND h.pos = d.pos)""")
def state_at_or_all(t):
    return iv.state_cards(_facts(t), entity_states(t), ["entity"], "pos").select(
        "entity", "pos", "ord", "lo", "hi", "covered"
    )


@query("compress_ranges", """
WITH d AS (SELECT DISTINCT doc_id AS n FROM labels),
r AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM d)
SELECT min(n) AS lo, max(n) AS hi, count(*) AS size,
       CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR)
            ELSE CAST(min(n) AS VARCHAR) || '-' || CAST(max(n) AS VARCHAR) END AS range
FROM r GROUP BY g""")
def compress_ranges(t):
    return iv.compress_ranges(t.labels, [], "doc_id")


@query("sequence_gaps", """
SELECT n AS missing FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS n FROM labels)
WHERE n NOT IN (SELECT doc_id FROM labels)""")
def sequence_gaps(t):
    return iv.sequence_gaps(t.labels, [], "doc_id")


_OVERLAP_SQL = """
WITH {st}, w AS (SELECT *, {agg} OVER (PARTITION BY entity ORDER BY lo, hi, ord {frame}) AS prev_hi FROM st)
SELECT entity, ord, lo, hi, prev_hi FROM w WHERE lo <= prev_hi"""


@query("overlaps", _OVERLAP_SQL.format(st=STATES_SQL, agg="lag(hi)", frame=""))
def overlaps(t):
    return iv.overlaps(_states(t), ["entity"])


@query("overlaps_running", _OVERLAP_SQL.format(
    st=STATES_SQL, agg="max(hi)", frame="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def overlaps_running(t):
    return iv.overlaps(_states(t), ["entity"], running=True)


_NORMALISED_SQL = f"""{STATES_SQL},
items AS (SELECT entity, ord, greatest(lo, 5) AS lo, least(hi, 45) AS hi FROM st WHERE hi >= 5 AND lo <= 45),
page AS (SELECT entity, unnest(range(lo, hi + 1)) AS pg, lo, hi, ord FROM items),
own AS (SELECT entity, pg, arg_min(ord, (lo, hi, ord)) AS ord FROM page GROUP BY 1, 2),
grid AS (SELECT e.entity, g.pg FROM (SELECT DISTINCT entity FROM items) e, (SELECT unnest(range(5, 46)) AS pg) g),
ff AS (SELECT grid.entity, grid.pg,
              last_value(own.ord IGNORE NULLS) OVER (PARTITION BY grid.entity ORDER BY grid.pg) AS o
       FROM grid LEFT JOIN own ON own.entity = grid.entity AND own.pg = grid.pg),
fst AS (SELECT entity, arg_min(ord, (lo, hi, ord)) AS o FROM items GROUP BY 1),
filled AS (SELECT ff.entity, ff.pg, coalesce(ff.o, fst.o) AS o FROM ff JOIN fst ON ff.entity = fst.entity),
flag AS (SELECT *, CASE WHEN o = lag(o) OVER (PARTITION BY entity ORDER BY pg) THEN 0 ELSE 1 END AS c FROM filled),
isl AS (SELECT *, sum(c) OVER (PARTITION BY entity ORDER BY pg) AS k FROM flag),
norm AS (SELECT entity, min(o) AS ord, min(pg) AS lo, max(pg) AS hi FROM isl GROUP BY entity, k
         UNION ALL SELECT entity, ord, lo, hi FROM st WHERE entity NOT IN (SELECT entity FROM items))"""


@query("normalise_states", f"WITH {_NORMALISED_SQL} SELECT entity, ord, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM norm")
def normalise_states(t):
    return iv.normalise_states(_states(t), ["entity"], 5, 45)


@query("repaired_keys", f"""WITH {_NORMALISED_SQL},
a AS (SELECT entity, string_agg(ord || ':' || lo || '-' || hi, ',' ORDER BY ord) AS s FROM st GROUP BY 1),
b AS (SELECT entity, string_agg(ord || ':' || lo || '-' || hi, ',' ORDER BY lo) AS s FROM norm GROUP BY 1)
SELECT a.entity FROM a JOIN b ON a.entity = b.entity WHERE a.s <> b.s""")
def repaired_keys(t):
    st = _states(t)
    return iv.repaired_keys(st, iv.normalise_states(st, ["entity"], 5, 45), ["entity"])


_REQ_SQL = "req AS (SELECT DISTINCT l_linenumber * 8 AS pos FROM lineitem)"
_GAPS_SQL = """SELECT e.entity, req.pos FROM (SELECT DISTINCT entity FROM {st}) e, req
WHERE NOT EXISTS (SELECT 1 FROM {st} s WHERE s.entity = e.entity AND req.pos BETWEEN s.lo AND s.hi)"""
_ERRORS_SQL = """SELECT entity, 'uncovered' AS rule, CAST(pos AS VARCHAR) AS detail FROM ({gaps})
UNION ALL
SELECT entity, 'overlap', CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END
FROM (SELECT *, lag(hi) OVER (PARTITION BY entity ORDER BY lo, hi, ord) AS ph FROM {st}) WHERE lo <= ph"""


@query("coverage_gaps", f"WITH {STATES_SQL}, {_REQ_SQL} " + _GAPS_SQL.format(st="st"))
def coverage_gaps(t):
    return iv.coverage_gaps(_states(t), _required(t), ["entity"], "pos")


@query("check_intervals", f"WITH {STATES_SQL}, {_REQ_SQL} "
       + _ERRORS_SQL.format(st="st", gaps=_GAPS_SQL.format(st="st")))
def check_intervals(t):
    return iv.interval_errors(_states(t), _required(t), ["entity"], "pos")


@query("repair_states", f"""WITH {_NORMALISED_SQL.replace('5 AND lo <= 45', '1 AND lo <= 60').replace('greatest(lo, 5)', 'greatest(lo, 1)')
       .replace('least(hi, 45)', 'least(hi, 60)').replace('range(5, 46)', 'range(1, 61)')}, {_REQ_SQL},
bad AS (SELECT DISTINCT entity FROM ({_ERRORS_SQL.format(st='st', gaps=_GAPS_SQL.format(st='st'))})),
still AS (SELECT DISTINCT entity FROM ({_ERRORS_SQL.format(st='norm', gaps=_GAPS_SQL.format(st='norm'))}))
SELECT entity, ord, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, entity NOT IN (SELECT entity FROM still) AS accepted
FROM norm WHERE entity IN (SELECT entity FROM bad)
UNION ALL SELECT entity, ord, lo, hi, true FROM st WHERE entity NOT IN (SELECT entity FROM bad)""")
def repair_states(t):
    return iv.repair_states(entity_states(t), _required(t), ["entity"], "pos", 1, 60)
