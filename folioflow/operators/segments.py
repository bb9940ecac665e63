"""Segments of ordered units, and attempts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.seeds import retry_seed
from .scan import numbered


def _cents(c: Column) -> Column:
    """Two decimals, independent of binary rounding of the input."""
    return F.round(c.cast("decimal(18,6)"), 2).cast("double")


def salvage_segments(used: DataFrame, units: DataFrame, keys: list[str], seg: str, pos: str, unit: str, duration: str) -> tuple[DataFrame, DataFrame]:
    """Known units only, the first use of each wins; durations shrink with the units lost.

    ``used`` has one row per listed unit. Returns the segments that keep a unit, and their units.
    """
    at = F.struct(F.col(seg).alias("seg"), F.col(pos).alias("pos"))
    kept = used.join(units.select(*keys, unit).distinct(), [*keys, unit], "left_semi").groupBy(*keys, unit).agg(F.min(at).alias("_a"))
    kept = kept.select(*keys, F.col("_a.seg").alias(seg), F.col("_a.pos").alias(pos), unit)
    total = used.groupBy(*keys, seg).agg(F.count(F.lit(1)).alias("_total"), F.max(duration).alias("_d"))
    n = kept.groupBy(*keys, seg).agg(F.count(F.lit(1)).alias("n_units"))
    base = F.when(F.coalesce(F.col("_d"), F.lit(0)) == 0, F.col("_total") * fixed.UNIT_SECONDS).otherwise(F.col("_d"))
    segs = n.join(total, [*keys, seg]).select(*keys, seg, "n_units", _cents(base * F.col("n_units") / F.col("_total")).alias("duration"))
    return segs, kept


def pack_sequential(
    units: DataFrame, keys: list[str], order: list[str], cost: float = fixed.UNIT_SECONDS, cap: float = fixed.MAX_SEGMENT_SECONDS, blocks=None
) -> DataFrame:
    """Consecutive units into segments of at most ``cap`` seconds at a fixed cost per unit."""
    per = max(1, math.floor(cap / cost))
    d = numbered(units, keys, order, "_rn", blocks)
    return d.withColumns({
        "seg": (F.floor((F.col("_rn") - 1) / per) + 1).cast("bigint"), "pos": (F.pmod(F.col("_rn") - 1, F.lit(per)) + 1).cast("int"),
    }).drop("_rn")


def half_split(segments: DataFrame, keys: list[str], n_units: str, duration: str, max_seconds: float = fixed.MAX_SEGMENT_SECONDS) -> DataFrame:
    """Halve segments that are too long, durations by share; clamp single units and the final range.

    Result columns: ``part_from`` (first unit, from 0), ``part_units``, ``part_seconds``. The halves of a
    segment are made inside its row, in as many rounds as its own count needs.
    """
    def part(first, n, seconds):
        return F.struct(first.cast("bigint").alias("first"), n.cast("bigint").alias("n"), seconds.cast("double").alias("seconds"))

    def halved(p):
        first, n, seconds = p["first"], p["n"], p["seconds"]
        half = F.floor(n / 2)
        two = F.array(part(first, half, _cents(seconds * half / n)), part(first + half, n - half, _cents(seconds * (n - half) / n)))
        return F.when((seconds > max_seconds) & (n >= 2), two).otherwise(F.array(p))

    rounds = F.ceil(F.log2(F.greatest(F.coalesce(F.col(n_units), F.lit(2)), F.lit(2)))) + 1
    start = F.array(part(F.lit(0), F.col(n_units), F.col(duration)))
    parts = F.aggregate(F.sequence(F.lit(1).cast("bigint"), rounds), start, lambda all, _: F.flatten(F.transform(all, halved)))
    d = segments.select("*", F.explode(parts).alias("_p"))
    seconds = F.least(F.greatest("_p.seconds", F.lit(1.0)), F.lit(float(max_seconds)))
    return d.select(*segments.columns, F.col("_p.first").alias("part_from"), F.col("_p.n").alias("part_units"), seconds.alias("part_seconds"))


def final_segments(
    used: DataFrame, units: DataFrame, keys: list[str], seg: str, pos: str, unit: str, order: list[str], duration: str, beat: str,
    max_seconds: float = fixed.MAX_SEGMENT_SECONDS, blocks: list[Column] | None = None, used_blocks: list[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Proposed segments made usable: salvaged, else packed anew, then halved where too long, and numbered.

    ``used`` has one row per listed unit with the ``duration`` and ``beat`` of its segment. A key keeps its
    salvaged segments only if their units, in order, are exactly its ``units`` in ``order``; a unit that is
    listed twice in the segment it stays in counts as a fault. All other keys are packed. Halves keep the
    beat of their segment; a blank beat gets the fallback text.

    Returns the segments (``seg`` from 1, ``n_units``, ``duration``, ``beat``, ``how``: salvaged or packed)
    and their units (``seg``, ``pos`` from 1, ``unit``), both with ``keys``.
    """
    segs, kept = salvage_segments(used, units, keys, seg, pos, unit, duration)
    wanted = numbered(units.select(*keys, unit, *[c for c in order if c not in (*keys, unit)]), keys, order, "_rn", blocks)
    placed = numbered(kept, keys, [seg, pos], "_at", used_blocks)
    both = wanted.join(placed.select(*keys, unit, "_at"), [*keys, unit], "left")
    twice = used.groupBy(*keys, seg, unit).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    twice = kept.join(twice, [*keys, seg, unit], "left_semi").select(*keys).distinct()
    good = both.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("_at") == F.col("_rn"), F.lit(False))).alias("_ok")).where("_ok").select(*keys).join(twice, keys, "left_anti")

    told = used.groupBy(*keys, seg).agg(F.max(F.when(F.trim(beat) != "", F.col(beat))).alias("_beat"))
    first = placed.groupBy(*keys, seg).agg(F.min("_at").alias("_first"))
    salvaged = segs.join(good, keys, "left_semi").join(told, [*keys, seg]).join(first, [*keys, seg]).select(
        *keys, F.col(seg).cast("bigint").alias("_seg"), "n_units", F.col("duration").alias("_seconds"), "_beat", F.lit("salvaged").alias("how"), "_first")
    per = max(1, math.floor(max_seconds / fixed.UNIT_SECONDS))
    packed = wanted.join(good, keys, "left_anti").groupBy(*keys, (F.floor((F.col("_rn") - 1) / per) + 1).cast("bigint").alias("_seg")).agg(
        F.count(F.lit(1)).alias("n_units"), F.min("_rn").alias("_first"))
    packed = packed.withColumns({"_seconds": (F.col("n_units") * fixed.UNIT_SECONDS).cast("double"), "_beat": F.lit(None).cast("string"), "how": F.lit("packed")})

    parts = half_split(salvaged.unionByName(packed), keys, "n_units", "_seconds", max_seconds)
    parts = numbered(parts, keys, ["_seg", "part_from"], "_no")
    members = parts.select(*keys, "_no", F.posexplode(F.sequence(F.col("_first") + F.col("part_from"), F.col("_first") + F.col("part_from") + F.col("part_units") - 1)).alias("_i", "_rn"))
    members = members.join(wanted, [*keys, "_rn"]).select(*keys, F.col("_no").alias("seg"), (F.col("_i") + 1).alias("pos"), unit)
    return parts.select(
        *keys, F.col("_no").alias("seg"), F.col("part_units").alias("n_units"), F.col("part_seconds").alias("duration"),
        F.coalesce("_beat", F.lit(fixed.FALLBACK_BEAT)).alias("beat"), "how"), members


def explode_attempts(units: DataFrame, seed: str, attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """One row per possible attempt with its seed."""
    d = units.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return d.withColumn("attempt_seed", retry_seed(F.col(seed), F.col("attempt")))
