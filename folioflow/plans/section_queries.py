"""Queries on fixed-heading documents."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import sections as sc
from .registry import query
from .views import SCRIPTS_SQL, scripts

_H = fixed.PANEL_HEADINGS
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_SECTIONS_SQL = SCRIPTS_SQL + r""",
sp AS (SELECT doc_id, unnest(string_split(chr(10) || text, chr(10) || '## ')) AS p, generate_subscripts(string_split(chr(10) || text, chr(10) || '## '), 1) - 1 AS ord FROM scripts),
secs AS (SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN ord = 0 THEN '' ELSE regexp_replace(split_part(p, chr(10), 1), '^\s+|\s+$', '', 'g') END AS heading,
  regexp_replace(CASE WHEN ord = 0 THEN p WHEN contains(p, chr(10)) THEN substr(p, instr(p, chr(10)) + 1) ELSE '' END, '^\s+|\s+$', '', 'g') AS body FROM sp)"""


@query("section_table", f"WITH {_SECTIONS_SQL} SELECT doc_id, ord, heading, body FROM secs")
def section_table(t):
    return sc.section_table(scripts(t), ["doc_id"], "text")


def _heading_errors_sql(pos_expr: str, advance: bool) -> str:
    """Pointer walk written as a fold over the heading list."""
    heads = "[" + ", ".join(f"'{h}'" for h in _H) + "]"
    late = "s.i" if advance else "w.last"
    return f"""WITH RECURSIVE {SCRIPTS_SQL},
hd AS (SELECT unnest({heads}) AS h, generate_subscripts({heads}, 1) AS n),
s AS (SELECT doc_id, n, h, {pos_expr} AS i FROM scripts, hd),
w AS (SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS last, CAST('' AS VARCHAR) AS errs FROM scripts
  UNION ALL SELECT w.doc_id, w.n + 1, CASE WHEN s.i = 0 THEN w.last WHEN s.i <= w.last THEN {late} ELSE s.i END,
    w.errs || CASE WHEN s.i = 0 THEN '|missing ' || s.h WHEN s.i <= w.last THEN '|order ' || s.h ELSE '' END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n + 1)
SELECT doc_id, substr(errs, 2) AS errors FROM w WHERE n = {len(_H)}"""


@query("check_headings", _heading_errors_sql("instr(text, h)", False))
def check_headings(t):
    return sc.check_headings(scripts(t), "text", _H).select("doc_id", F.array_join("errors", "|").alias("errors"))


@query("check_headings_line", _heading_errors_sql("instr(chr(10) || text || chr(10), chr(10) || h || chr(10))", False))
def check_headings_line(t):
    return sc.check_headings(scripts(t), "text", _H, mode="line").select("doc_id", F.array_join("errors", "|").alias("errors"))


@query("check_fields_order", _heading_errors_sql("instr(text, h)", True))
def check_fields_order(t):
    return scripts(t).select("doc_id", F.array_join(sc.heading_errors(F.col("text"), _H, advance_on_error=True), "|").alias("errors"))


_TITLES = [h[3:] for h in _H]


def _repair_sql() -> str:
    """Positions of the known headings in the normalised text; a section ends where the next one begins."""
    fixed_text = "text"
    for h in _H:
        fixed_text = f"regexp_replace({fixed_text}, '(?m)^#+\\s*{h[3:]}', '{h}', 'g')"
    places = ", ".join(f"instr(text, '{h}')" for h in _H)
    parts = []
    for k, h in enumerate(_H, 1):
        begin = f"(i[{k}] + {len(h)})"
        stop = f"coalesce(list_min(list_filter(i, lambda x: x > i[{k}])), length(text) + 1)"
        body = f"CASE WHEN i[{k}] > 0 THEN {_STRIP.format(f'substr(text, {begin}, {stop} - {begin})')} END"
        if k == 1:
            lead = "substr(text, 1, coalesce(list_min(list_filter(i, lambda x: x > 0)), length(text) + 1) - 1)"
            body = f"coalesce({body}, {_STRIP.format(lead)})"
        spare = "lang" if k == 2 else "nullif(source, 'src1')" if k == 5 else "NULL"
        parts.append(f"'{h}' || chr(10) || coalesce(nullif({body}, ''), {spare}, '（无）')")
    joined = " || chr(10) || chr(10) || ".join(parts)
    return f"""WITH {SCRIPTS_SQL}, nrm AS (SELECT doc_id, lang, source, {fixed_text} AS text FROM scripts),
placed AS (SELECT *, [{places}] AS i FROM nrm)
SELECT doc_id, {joined} AS text FROM placed"""


@query("repair_headings", _repair_sql())
def repair_headings(t):
    spare = {_H[1]: F.col("lang"), _H[4]: F.when(F.col("source") != "src1", F.col("source"))}
    return sc.repair_headings(scripts(t), "text", _H, spare).select("doc_id", "text")


@query("ensure_headings", f"""
WITH d AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '{fixed.PAGE_HEADINGS[0]}' || chr(10) || text ELSE '#{fixed.PAGE_HEADINGS[0]}' || chr(10) || text || chr(10) || '{fixed.PAGE_HEADINGS[2]}' END AS text FROM documents),
a AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 > 0 THEN text ELSE '{fixed.PAGE_HEADINGS[0]}' || chr(10) || chr(10) || {_STRIP.format('text')} END AS text FROM d),
b AS (SELECT doc_id, lang, {_STRIP.format('text')} || chr(10) || chr(10) || '{fixed.PAGE_HEADINGS[1]}' || chr(10) || chr(10) || lang AS text FROM a)
SELECT doc_id, CASE WHEN contains(text, '{fixed.PAGE_HEADINGS[2]}') THEN text ELSE {_STRIP.format('text')} || chr(10) || chr(10) || '{fixed.PAGE_HEADINGS[2]}' || chr(10) || chr(10) || 'end' END AS text FROM b""")
def ensure_headings(t):
    h = fixed.PAGE_HEADINGS
    m = F.col("doc_id") % 4
    text = (F.when(m == 0, F.col("text")).when(m == 1, F.concat(F.lit(h[0] + "\n"), "text"))
            .otherwise(F.concat(F.lit("#" + h[0] + "\n"), "text", F.lit("\n" + h[2]))))
    d = t.documents.select("doc_id", "lang", text.alias("text"))
    return sc.ensure_headings(d, "text", h, {h[1]: F.col("lang"), h[2]: F.lit("end")}).select("doc_id", "text")


@query("summary_fallback", r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN substr(lang || ' summary of a document with a long tail', 1, 30)
  ELSE substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], 1, 30) END AS summary FROM documents""")
def summary_fallback(t):
    m = F.col("doc_id") % 3
    s = sc.summary_fallback(
        F.when(m == 0, F.col("source")).otherwise(" "),
        F.when(m == 1, F.concat("lang", F.lit(" summary of a document with a long tail"))), F.concat(F.lit("# T\n"), "text"), F.lit("none"))
    return t.documents.select("doc_id", s.alias("summary"))


@query("dialogue_table", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
d AS (SELECT doc_id, CAST(i AS INT) AS pos, CASE i % 6 WHEN 0 THEN '- ' || split_part(s, ' ', 1) || '：' || substr(s, 1, 20) WHEN 1 THEN '（无）' WHEN 2 THEN '（本镜 ' || left(s, 3) || '）'
   WHEN 3 THEN split_part(s, ' ', 1) || ': ' || left(s, 9) || '：x' WHEN 4 THEN s ELSE '  ' END AS s FROM l),
e AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^[-*• ]+', ''), '^\s+|\s+$', '', 'g') AS s FROM d WHERE pos % 6 NOT IN (1, 2, 5)),
f AS (SELECT doc_id, pos, s, CASE WHEN contains(s, '：') THEN instr(s, '：') ELSE instr(s, ':') END AS c FROM e WHERE s <> ''),
g AS (SELECT doc_id, pos, CASE WHEN c = 0 THEN '?' ELSE regexp_replace(substr(s, 1, c - 1), '^\s+|\s+$', '', 'g') END AS speaker, CASE WHEN c = 0 THEN s ELSE regexp_replace(substr(s, c + 1), '^\s+|\s+$', '', 'g') END AS text FROM f)
SELECT * FROM g WHERE text <> ''""")
def dialogue_table(t):
    def line(s, i):
        k, w = i % 6, F.substring_index(s, " ", 1)
        return (F.when(k == 0, F.concat(F.lit("- "), w, F.lit("："), F.substring(s, 1, 20))).when(k == 1, "（无）")
                .when(k == 2, F.concat(F.lit("（本镜 "), F.substring(s, 1, 3), F.lit("）"))).when(k == 3, F.concat(w, F.lit(": "), F.substring(s, 1, 9), F.lit("：x")))
                .when(k == 4, s).otherwise("  "))
    d = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("body"))
    return sc.dialogue_table(d, ["doc_id"], "body")


@query("panel_digest", _SECTIONS_SQL.join(["WITH ", r""",
b AS (SELECT s.doc_id, coalesce(max(body) FILTER (heading = '出场人物'), '') AS cast_body,
   coalesce(nullif(max(body) FILTER (heading = '动作与姿态'), ''), nullif(max(body) FILTER (heading = '氛围与情绪'), ''), '') AS gist FROM secs s GROUP BY 1),
c AS (SELECT doc_id, len(list_filter(string_split(cast_body, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS people, regexp_replace(regexp_replace(gist, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS g FROM b),
e AS (SELECT *, substr(g, 1, 80) AS hd, instr(reverse(substr(g, 1, 80)), ' .') AS k FROM c)
SELECT doc_id, CAST(people AS INT) AS people, CASE WHEN g = '' THEN '（见 L3 脚本）' WHEN length(g) <= 80 THEN g WHEN k > 0 AND 79 - k > 40 THEN substr(hd, 1, 81 - k) || '……' ELSE hd || '……' END AS gist FROM e"""]))
def panel_digest(t):
    return sc.panel_digest(scripts(t), "text", "出场人物", ["动作与姿态", "氛围与情绪"]).select("doc_id", "people", "gist")
