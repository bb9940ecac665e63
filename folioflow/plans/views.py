"""Domain-shaped views of the shared tables, in Spark and as SQL for the reference texts.

page = order, panel = lineitem, entity = part/supplier/customer, script = document,
dialogue = conversation, telemetry/attempt/ledger = event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Tables

PANEL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

STATES_SQL = """st AS (
  SELECT l_partkey AS entity, l_orderkey * 16 + l_linenumber AS ord,
         min(CAST(l_quantity AS INT)) AS lo,
         max(CAST(l_quantity AS INT) + CAST(round(l_tax * 100) AS INT)) AS hi
  FROM lineitem GROUP BY 1, 2)"""


def entity_states(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return (
        t.lineitem.select(
            F.col("l_partkey").alias("entity"),
            (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"),
            q.alias("lo"),
            (q + F.round(F.col("l_tax") * 100).cast("int")).alias("hi"),
        )
        .groupBy("entity", "ord")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def panel_blocks():
    """Blocks of the panel order for runs inside a page."""
    return [F.col("l_linenumber").cast("bigint"), F.floor(F.col("l_partkey") / 65536)]


def scripts(t: Tables) -> DataFrame:
    """Documents as panel scripts: every third line opens the next fixed heading.

    The heading of rank 3 is left out of every seventh document, ranks 1 and 2 are swapped in
    every fifth, and rank 4 has another level in every third.
    """
    from ..functions.fixed import PANEL_HEADINGS

    heads = F.array(*[F.lit(h) for h in PANEL_HEADINGS])
    doc = F.col("doc_id")

    def line(s, i):
        k = (i / 3).cast("int")
        k = F.when((doc % 5 == 0) & (k == 1), 2).when((doc % 5 == 0) & (k == 2), 1).otherwise(k)
        head = F.when((doc % 3 == 0) & (k == 4), F.concat(F.lit("#"), F.element_at(heads, 5))).otherwise(F.element_at(heads, k + 1))
        opens = (i % 3 == 0) & (i < 30) & ~((doc % 7 == 0) & (k == 3))
        # index kept in range for the lines that open nothing
        return F.when(opens, F.concat(head, F.lit("\n"), s)).otherwise(s)

    d = t.documents.withColumn("_l", F.split("text", "\n"))
    numbered = F.transform("_l", lambda s, i: F.when(i < 30, line(s, F.least(i, F.lit(29)))).otherwise(s))
    return d.select("doc_id", "lang", "source", F.array_join(numbered, "\n").alias("text"))


def _scripts_sql() -> str:
    from ..functions.fixed import PANEL_HEADINGS

    heads = "[" + ", ".join(f"'{h}'" for h in PANEL_HEADINGS) + "]"
    return f"""sl AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
sk AS (SELECT *, CASE WHEN doc_id % 5 = 0 AND i // 3 = 1 THEN 2 WHEN doc_id % 5 = 0 AND i // 3 = 2 THEN 1 ELSE i // 3 END AS k FROM sl),
sh AS (SELECT *, CASE WHEN i % 3 = 0 AND i < 30 AND NOT (doc_id % 7 = 0 AND k = 3)
   THEN CASE WHEN doc_id % 3 = 0 AND k = 4 THEN '#' ELSE '' END || ({heads})[k + 1] END AS h FROM sk),
scripts AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, string_agg(CASE WHEN h IS NOT NULL THEN h || chr(10) || s ELSE s END, chr(10) ORDER BY i) AS text FROM sh GROUP BY doc_id)"""


SCRIPTS_SQL = _scripts_sql()
