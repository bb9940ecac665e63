"""Nested records, section documents, stage logs and run ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import number
from ..session import cut_lineage

PAGE_SCHEMA = """
  page INT, file STRING, summary STRING, notes STRING,
  panels ARRAY<STRUCT<no: INT, key: STRING, bbox: ARRAY<DOUBLE>, shape: STRING, crop: STRING,
    detail: STRUCT<characters: ARRAY<STRUCT<name: STRING, appearance: STRING>>,
                   dialogue: ARRAY<STRUCT<speaker: STRING, text: STRING>>,
                   onomatopoeia: ARRAY<STRING>, action: STRING, setting: STRING,
                   camera: STRING, clothing_notes: STRING>>>, _corrupt STRING"""

SETTINGS_SCHEMA = """
  characters ARRAY<STRUCT<name: STRING, aliases: ARRAY<STRING>, gender: STRING, appearance_cn: STRING,
    danbooru_tags: STRING, anchor: STRUCT<character_name: STRING, anime_origin: STRING, anchor_danbooru: STRING>,
    clothing_states: ARRAY<STRUCT<pages: STRING, state_cn: STRING, danbooru_tags: STRING>>>>,
  environments ARRAY<STRUCT<name: STRING, desc_cn: STRING, danbooru_tags: STRING>>, style_notes STRING"""

_STAGES = (
    "map<string,struct<status:string,note:string,items:map<string,struct<status:string,data:string>>>>"
)
_LOG = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) \[(\w+)\] (.*)$"


def read_page_records(spark: SparkSession, path: str) -> DataFrame:
    """Page JSON files; unreadable ones keep their text in ``_corrupt``."""
    return (
        spark.read.schema(PAGE_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )


def read_section_docs(spark: SparkSession, path: str, name_pattern: str) -> DataFrame:
    """Whole text files with the key that the first group of the pattern finds in the file name."""
    df = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", name_pattern, 1).alias("doc"), F.col("value").alias("text")
    )
    return df.where(F.col("doc") != "")


def _log_columns(df: DataFrame, line: str) -> DataFrame:
    part = lambda i: F.regexp_extract(line, _LOG, i)
    seconds = lambda name: number(F.regexp_extract(line, name + r"=([0-9]+(?:\.[0-9]+)?)s", 1), "double")
    chars = lambda name: number(F.regexp_extract(line, name + r"=(\d+)c", 1), "int")
    return df.withColumns({
        "log_ts": F.to_timestamp_ntz(F.concat(part(1), F.lit("."), part(2)), F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
        "level": part(3), "message": part(4),
        "ok_seconds": number(F.regexp_extract(line, r"llm ok in ([0-9]+(?:\.[0-9]+)?)s", 1), "double"),
        "failed": F.col(line).rlike(r"attempt \d+ failed"),
        "ttft_seconds": seconds("ttft"), "total_seconds": seconds("total"), "decode_seconds": seconds("decode"),
        "content_chars": chars("content"), "reasoning_chars": chars("reasoning"),
    })


def parse_log_lines(df: DataFrame, line: str) -> DataFrame:
    """``ts [LEVEL] message`` lines into columns. Other lines are not records; ``stitch_log_lines`` keeps them."""
    return _log_columns(df.where(F.col(line).rlike(_LOG)), line)


def stitch_log_lines(df: DataFrame, line: str, keys: list[str], block: str, ord: str) -> tuple[DataFrame, DataFrame]:
    """Log records, and the lines that continue them.

    A line that does not begin with a time (a traceback, a printed text) belongs to the record before it in the order
    (``block``, ``ord``) of its ``keys``, e.g. the parts of a file and the lines of a part. Records have ``more_lines``, how many
    follow them; continuation lines have ``record_block`` and ``record_ord`` of theirs, null if none came before. Every
    line is in one of the two. A window runs inside a block, one row per block is carried on, so a long file is not one task.
    """
    starts = F.coalesce(F.col(line).rlike(_LOG), F.lit(False))
    w = Window.partitionBy(*keys, block).orderBy(ord)
    d = df.withColumn("_start", starts).withColumn("_in", F.last(F.when(F.col("_start"), F.col(ord)), ignorenulls=True).over(w))
    ends = d.groupBy(*keys, block).agg(F.max(F.when(F.col("_start"), F.col(ord))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_end").isNotNull(), F.struct(F.col(block).alias("b"), F.col("_end").alias("o")))
    carry = ends.select(*keys, block, F.last(known, ignorenulls=True).over(before).alias("_carry"))
    on = [*keys, block]
    carry = carry.toDF(*["_k" + str(i) for i in range(len(on))], "_carry")
    d = d.join(carry, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]), "left").drop(*[f"_k{i}" for i in range(len(on))])
    here = F.col("_in").isNotNull()
    d = cut_lineage(d.select(*df.columns, "_start", F.when(here, F.col(block)).otherwise(F.col("_carry.b")).alias("record_block"),
                             F.when(here, F.col("_in")).otherwise(F.col("_carry.o")).alias("record_ord")), "lines")
    more = d.where(~F.col("_start")).drop("_start")
    counts = more.where(F.col("record_ord").isNotNull()).groupBy(*[F.col(k).alias("_k_" + k) for k in keys], "record_block", "record_ord").agg(F.count(F.lit(1)).alias("more_lines"))
    records = d.where("_start").drop("_start", "record_block", "record_ord")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys], (F.col(block) == F.col("record_block")) & (F.col(ord) == F.col("record_ord")))
    records = records.join(counts, same, "left").select(*df.columns, F.coalesce("more_lines", F.lit(0).cast("bigint")).alias("more_lines"))
    return _log_columns(records, line), more


def read_stage_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and continuation lines (``stitch_log_lines``) of ``<stage>.log`` files.

    ``part`` is where the part of the file that a task reads begins, ``ord`` counts up along its lines.
    """
    d = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.log$", 1).alias("stage"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return stitch_log_lines(cut_lineage(d, "log"), "line", ["stage", "file"], "part", "ord")


def ledger_rows(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Stage map with item maps as long rows: one per stage (item null), one per item. See ``split_ledger``."""
    stages = df.select(*keys, F.explode(F.from_json(col, _STAGES)).alias("stage", "_s"))
    head = stages.select(
        *keys, "stage", F.lit(None).cast("string").alias("item"), F.col("_s.status").alias("status"),
        F.lit(None).cast("string").alias("data"), F.col("_s.note").alias("note"),
    )
    items = stages.select(*keys, "stage", F.explode("_s.items").alias("item", "_i")).select(
        *keys, "stage", "item", "_i.status", "_i.data", F.lit(None).cast("string").alias("note")
    )
    return head.unionByName(items)


def split_ledger(df: DataFrame, col: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ledger rows, and the runs that cannot be read with their text and ``error``: ``not JSON``, ``no stages`` (null, not a map
    of stages) or ``bad stage <names>`` (a stage that is not an object with a status; such a run is not read in part)."""
    text = F.col(col)
    v = F.try_parse_json(text)
    is_map = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    stages = F.from_json(F.when(is_map, text), "map<string,string>")
    bad = F.filter(F.map_entries(stages), lambda e: F.coalesce(F.get_json_object(e["value"], "$.status"), F.lit("")) == "")
    names = F.concat_ws(", ", F.transform(bad, lambda e: e["key"]))
    error = F.when(text.isNull() | (is_map & F.coalesce(F.size(F.map_keys(stages)) == 0, F.lit(True))), "no stages").when(v.isNull(), "not JSON").when(
        ~is_map, "no stages").when(F.size(bad) > 0, F.concat(F.lit("bad stage "), names))
    d = df.withColumn("error", error)
    return ledger_rows(d.where("error IS NULL"), col, keys), d.where("error IS NOT NULL").select(*keys, F.col(col), "error")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Run files ``{id, created, params, stages}`` as ledger rows, and the files that cannot be read: ``run_id`` (the file's name
    if it has no id), ``stages`` (the whole text if there are none) and ``error``. Spark's readers pass over files of no bytes."""
    d = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    whole = F.try_parse_json("value").isNotNull()
    d = d.select(
        F.coalesce(F.get_json_object(F.when(whole, F.col("value")), "$.id"), F.col("name")).alias("run_id"),
        F.when(~whole, F.col("value")).otherwise(F.get_json_object("value", "$.stages")).alias("stages"))
    return split_ledger(d, "stages", ["run_id"])


def json_value(df: DataFrame, col: str, schema: str, out: str = "record") -> tuple[DataFrame, DataFrame]:
    """Parsed JSON of a model reply (code fence stripped), and the rows where none was found.

    The plain and the fenced reply are parsed on the JVM; only replies with text around the
    value go through the bracket scan in Python, the others enter it as nulls.
    """
    from .json_scan import first_json

    d = df.withColumn("_f", F.regexp_extract(col, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1))
    d = d.withColumn("_body", F.trim(F.when(F.col("_f") != "", F.col("_f")).otherwise(F.col(col)), F.lit(" \n\r\t"))).drop("_f")
    first, last = F.substring("_body", 1, 1), F.substring("_body", -1, 1)
    framed = ((first == "{") & (last == "}")) | ((first == "[") & (last == "]"))
    d = d.withColumn("_easy", F.coalesce(framed & F.try_parse_json("_body").isNotNull(), F.lit(False)))
    d = d.withColumn("_scan", first_json(F.when(~F.col("_easy"), F.col("_body"))))
    d = d.withColumn(out, F.from_json(F.when(F.col("_easy"), F.col("_body")).otherwise(F.col("_scan")), schema))
    d = d.drop("_body", "_easy", "_scan")
    return d.where(F.col(out).isNotNull()), d.where(F.col(out).isNull()).drop(out)
