"""Order-dependent operators. They run on :func:`ordered_scan`, so a hot key is cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import let
from .scan import by_width, numbered, ordered_scan, table_order
from .shape import rule_errors


def global_order(df: DataFrame, page: str, rest: list[str], out: str = "position", blocks=None) -> DataFrame:
    """Dense 1..n over the whole table by (page, ...); ``blocks`` cut the order inside a page."""
    return table_order(df, page, rest, out, blocks)


def chunk(df: DataFrame, keys: list[str], order: list[str], size: int = 4, blocks=None) -> DataFrame:
    """Consecutive rows in chunks of ``size``, numbered from 0."""
    d = numbered(df, keys, order, "_rn", blocks)
    return d.withColumn("chunk", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, first: str, missing: str, blocks=None) -> DataFrame:
    """Value of the unit before, with one marker for the first unit and one for an absent value."""
    d = ordered_scan(df, keys, order, blocks, row_number="_rn", previous={"_prev": F.col(value)})
    text = F.when(F.col("_rn") == 1, F.lit(first)).otherwise(F.coalesce(F.when(F.col("_prev") != "", F.col("_prev")), F.lit(missing)))
    return d.withColumn("previous", text).drop("_rn", "_prev")


def continuity(
    df: DataFrame, keys: list[str], order: list[str], start: str, end: str, duration: str, blocks=None
) -> DataFrame:
    """Per key: does it start at 0, where is the first break, does it reach the whole seconds of the duration."""
    d = ordered_scan(df, keys, order, blocks, row_number="_rn", previous={"_pe": F.col(end)})
    broken = F.col("_pe").isNotNull() & (F.col("_pe") != F.col(start))
    return d.groupBy(*keys).agg(
        (F.min(F.when(F.col("_rn") == 1, F.col(start))) == 0).alias("starts_at_zero"),
        F.min(F.when(broken, F.col("_rn"))).alias("first_break"),
        (F.max_by(end, F.col("_rn")) >= F.floor(F.max(duration))).alias("reaches_end"))


def shot_errors(text: Column, duration: Column) -> Column:
    """Broken rules on the shot numbers and time stamps of a prompt. All inside one row."""
    pattern = F.lit(r"\[Shot (\d+)\] At (\d{2}:\d{2}\.\d{3})")
    found = F.struct(
        F.transform(F.regexp_extract_all(text, pattern, 1), lambda n: n.try_cast("int")).alias("nos"),
        F.transform(F.regexp_extract_all(text, pattern, 2), lambda t: (
            F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 6).cast("double"))).alias("secs"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[Shot (\d+)\]"), 1), lambda n: n.try_cast("int"))).alias("bare"))

    def rules(s):
        nos, secs, bare = s["nos"], s["secs"], s["bare"]
        k = F.coalesce(F.array_max(bare), F.lit(0))
        unsorted = F.exists(F.sequence(F.lit(1), F.greatest(F.size(secs), F.lit(1))), lambda i: (i < F.size(secs)) & (
            F.try_element_at(secs, i + 1) <= F.try_element_at(secs, i)))
        # 2..k without gap or repeat, told by number, least and largest
        timed = F.array_distinct(nos)
        whole = (F.size(nos) == k - 1) & (F.size(timed) == k - 1) & (F.array_min(nos) == 2) & (F.array_max(nos) == k)
        return rule_errors({
            "shot 1 missing": ~F.coalesce(F.array_contains(bare, 1), F.lit(False)),
            "shot 1 has a time": F.coalesce(F.array_contains(nos, 1), F.lit(False)),
            "shot numbers not contiguous": F.exists(bare, lambda n: n.isNull()) | (F.size(bare) > 0) & ((F.size(bare) != k) | (F.coalesce(F.array_min(bare), F.lit(1)) != 1)),
            "timed shots incomplete": (k >= 2) & ~F.coalesce(whole, F.lit(False)),
            "times not increasing": unsorted,
            "time out of range": F.exists(secs, lambda t: ~((t > 0) & (t < duration))),
        })

    return let(found, rules)


def crossfade_offsets(media: DataFrame, keys: list[str], order: list[str], duration: str, fade: float = fixed.CROSSFADE_SECONDS, blocks=None) -> DataFrame:
    """Start of each cross-fade: length before it less one fade per clip; the first clip has none."""
    d = ordered_scan(media, keys, order, blocks, row_number="clip", sums={"_before": F.col(duration).cast("decimal(18,3)")})
    k = F.col("clip") - 1
    offset = F.col("_before") - k * F.lit(fade).cast("decimal(10,3)")
    return d.withColumn("offset", F.when(k > 0, offset).cast("double")).drop("_before")


def crossfade_total(media: DataFrame, keys: list[str], duration: str, fade: float = fixed.CROSSFADE_SECONDS) -> DataFrame:
    n = F.count(F.lit(1))
    total = F.sum(F.col(duration).cast("decimal(18,3)")) - (n - 1) * F.lit(fade).cast("decimal(10,3)")
    return media.groupBy(*keys).agg(n.alias("clips"), total.cast("double").alias("total"))


def stack_layout(
    lines: DataFrame, panel: list[str], kind: str, order: list[str], w: str, h: str, page_w: str, page_h: str, blocks=None
) -> DataFrame:
    """Default places: bubbles down the right, narration down the left, sounds at the lower left."""
    margin, gap = F.floor(F.col(page_w) * 0.03), F.floor(F.col(page_h) * 0.02)
    d = ordered_scan(lines, [*panel, kind], order, blocks, sums={"_above": (F.col(h) + gap).cast("bigint")})
    pw, ph = F.col(page_w), F.col(page_h)
    x = F.when(F.col(kind) == "bubble", pw - F.col(w) - margin).otherwise(margin)
    y = F.when(F.col(kind) == "sfx", ph - F.col(h) - margin).otherwise(margin + F.col("_above"))
    return d.withColumns({"x": x / pw, "y": y / ph}).drop("_above")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record per key, with the number of records it replaced."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(last.alias("_l"), (F.count(F.lit(1)) - 1).alias("replaced")).select(
        *keys, *[F.col("_l")[c].alias(c) for c in rest], "replaced")


def first_seen(df: DataFrame, entity: str, chunk_no: str) -> DataFrame:
    """Chunk in which each entity first appears."""
    return df.groupBy(entity).agg(F.min(chunk_no).alias("first_chunk"))


def roster_sizes(df: DataFrame, entity: str, chunk_no: str) -> DataFrame:
    """Per chunk: entities new in it and entities known before it. The roster before chunk i is
    ``first_seen(...)`` with ``first_chunk < i``; it is not written out per chunk."""
    new = first_seen(df, entity, chunk_no).groupBy(F.col("first_chunk").alias(chunk_no)).agg(F.count(F.lit(1)).alias("n_new"))
    d = df.select(chunk_no).distinct().join(new, chunk_no, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return ordered_scan(d, [], [chunk_no], by_width(F.col(chunk_no), 1 << 20), sums={"n_before": F.col("n_new")})


def assign_lanes(df: DataFrame, order: list[str], lanes: int, blocks=None) -> DataFrame:
    """Round-robin lane by position in the whole table."""
    return numbered(df, [], order, "_rn", blocks).withColumn("lane", F.pmod(F.col("_rn") - 1, F.lit(lanes)).cast("int")).drop("_rn")


def shot_table_gate(
    shots: DataFrame, table: list[str], order: list[str], hook: str, seconds: str, cast: str, covered: str, blocks=None
) -> DataFrame:
    """Four checks per shot table: hooks dense enough, strong first and last hook, length, cast, seconds covered."""
    strong = F.col(hook).isin(fixed.HOOK_STRONG)
    d = numbered(shots, table, order, "_rn", blocks)
    turn = F.when(F.col(hook).isin(fixed.HOOK_TURNS), F.col("_rn"))
    d = ordered_scan(d, table, ["_rn"], by_width(F.col("_rn"), 65536), last_known={"_turn": turn})
    dull = (F.col("_rn") - F.coalesce("_turn", F.lit(0)) >= 3)
    return d.groupBy(*table).agg(
        (~F.bool_or(dull)).alias("hooks_dense"),
        (F.bool_or((F.col("_rn") == 1) & strong) & F.max(F.struct("_rn", strong.alias("s")))["s"]).alias("ends_strong"),
        (F.max(seconds) <= fixed.SHOT_MAX_SECONDS).alias("short_enough"),
        (F.max(cast) <= fixed.SHOT_MAX_CAST).alias("cast_ok"),
        F.bool_and(F.col(covered) >= F.ceil(seconds)).alias("seconds_covered"))


def stage_overlap(spans: DataFrame, run: str, stage: str, start: str, end: str) -> DataFrame:
    """Overlap in seconds of each two stages of a run (one span per run and stage: few per run)."""
    per = spans.groupBy(run, stage).agg(F.min(start).alias("s"), F.max(end).alias("e"))
    a, b = per.alias("a"), per.alias("b")
    lo, hi = F.greatest("a.s", "b.s"), F.least("a.e", "b.e")
    return a.join(b, (F.col(f"a.{run}") == F.col(f"b.{run}")) & (F.col(f"a.{stage}") < F.col(f"b.{stage}"))).select(
        F.col(f"a.{run}").alias(run), F.col(f"a.{stage}").alias("stage_a"), F.col(f"b.{stage}").alias("stage_b"),
        (lo < hi).alias("overlaps"),
        F.when(lo < hi, F.timestamp_diff("SECOND", lo, hi)).otherwise(F.lit(0)).cast("bigint").alias("seconds"))
