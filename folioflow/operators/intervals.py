"""States that hold over position intervals: lookup, ranges, gaps, overlaps, repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import span_text
from ..session import cut_lineage
from .scan import by_width, cut_keys, large_keys, numbered, ordered_scan

# An interval is cut into single positions and runs of 64, 64 x 64, ... positions, as many levels as
# the widest interval needs, so that a position meets it by equality on exactly one node.
_BITS = 6
_FAN = 1 << _BITS
#: intervals of a task that reduces them to one per node
_TASK = 1 << 18


def levels_of(intervals: DataFrame, lo: str, hi: str) -> int:
    """Levels at which an interval of the table can hold a whole run; an interval then has fewer than 128 nodes per level."""
    width = intervals.agg(F.max(F.col(hi).cast("bigint") - F.col(lo).cast("bigint"))).first()[0]
    return 1 + max(0, ((width or 0) + 1).bit_length() - 1) // _BITS


def _seq(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Array of ``struct<level,node>`` covering ``lo..hi`` exactly once."""
    first = F.struct(lo.alias("lo"), hi.alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def step(acc, level):
        a, b = acc["lo"], acc["hi"]
        up_a, up_b = F.shiftright(a + (_FAN - 1), _BITS), F.shiftright(b + 1, _BITS) - 1
        inner = (up_a <= up_b) & (level < levels - 1)
        edges = F.when(inner, F.concat(_seq(a, up_a * _FAN - 1), _seq((up_b + 1) * _FAN, b))).otherwise(_seq(a, b))
        found = F.transform(edges, lambda p: F.struct(level.alias("level"), p.alias("node")))
        rest = lambda c, none: F.when(inner, c).otherwise(F.lit(none).cast("bigint"))
        return F.struct(rest(up_a, 1).alias("lo"), rest(up_b, 0).alias("hi"), F.concat(acc["nodes"], found).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), first, step, lambda acc: acc["nodes"])


def interval_nodes(df: DataFrame, lo: str, hi: str, levels: int) -> DataFrame:
    """One row per (interval, node); columns ``level`` and ``node`` are added."""
    lo_c, hi_c = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
    return df.where(lo_c <= hi_c).select("*", F.inline(_nodes(lo_c, hi_c, levels)))


def _probes(points: DataFrame, pos: str, levels: int) -> DataFrame:
    """One row per point and level, with the node the point lies in."""
    p = F.col(pos).cast("bigint")
    nodes = [F.struct(F.lit(i).alias("level"), F.shiftright(p, _BITS * i).alias("node")) for i in range(levels)]
    return points.select("*", F.inline(F.array(*nodes)))


def covering_pairs(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, lo: str, hi: str) -> DataFrame:
    """Every (point, interval) with the same keys and ``lo <= pos <= hi``; only true pairs are built."""
    on, levels = [*keys, "level", "node"], levels_of(intervals, lo, hi)
    return _probes(points, pos, levels).join(interval_nodes(intervals, lo, hi, levels), on).drop("level", "node")


def state_at(
    facts: DataFrame, states: DataFrame, keys: list[str], pos: str, *,
    lo: str = "lo", hi: str = "hi", ord: str = "ord", payload: list[str] = (), policy: str,
) -> DataFrame:
    """The state whose interval contains the position of each fact, else null.

    ``latest_listed``: of several, the one last in ``ord``. ``earliest_start``: the one that
    sorts first by (lo, hi, ord). ``ord`` is unique within a key. States are reduced to one per node and facts to their distinct
    positions before the two meet, so no pairs are built however many states overlap. The states of a key are reduced in one
    task of at most some hundred thousand states, those of a key of more of them in several.
    """
    if policy not in ("latest_listed", "earliest_start"):
        raise ValueError(f"unknown policy {policy!r}")
    states = cut_lineage(states.select(*dict.fromkeys([*keys, lo, hi, ord, *payload])))  # read several times below
    on, levels = [*keys, "level", "node"], levels_of(states, lo, hi)
    probes = _probes(facts.select(*keys, pos).distinct(), pos, levels)
    best = F.max(ord) if policy == "latest_listed" else F.min(F.struct(lo, hi, ord))
    tasks = 1 + states.count() // _TASK
    small, many = cut_keys(states.select(*dict.fromkeys([*keys, lo, hi, ord])), keys, large_keys(states, keys))
    reduced = [interval_nodes(d, lo, hi, levels).groupBy(*on).agg(best.alias("_b")) for d in (small.repartition(tasks, *keys), many) if d is not None]
    hits = probes.join(reduce(DataFrame.unionByName, reduced), on).groupBy(*keys, pos)
    if policy == "latest_listed":
        hits = hits.agg(F.max("_b").alias("state_" + ord))
    else:
        hits = hits.agg(F.min("_b")[ord].alias("state_" + ord))
    more = [c for c in payload if c != ord]
    if more:
        named = states.select(*keys, F.col(ord).alias("state_" + ord), *[F.col(c).alias("state_" + c) for c in more])
        hits = hits.join(named, [*keys, "state_" + ord])
    out = ["state_" + c for c in dict.fromkeys([ord, *payload])]
    return facts.join(hits, [*keys, pos], "left").select(*facts.columns, *out)


def state_cards(
    facts: DataFrame, states: DataFrame, keys: list[str], pos: str, *,
    lo: str = "lo", hi: str = "hi", ord: str = "ord",
) -> DataFrame:
    """Per distinct (key, position): all states covering it, or all states if none does."""
    points = facts.select(*keys, pos).distinct()
    hits = covering_pairs(points, states, keys, pos, lo, hi).withColumn("covered", F.lit(True))
    bare = points.join(hits.select(*keys, pos).distinct(), [*keys, pos], "left_anti")
    rest = bare.join(states, keys).withColumn("covered", F.lit(False))
    return hits.unionByName(rest.select(*hits.columns))


def _span_blocks(lo: str, hi: str, ord: str, width: int = 65536) -> list[Column]:
    """Starts may repeat a lot, so block by the exact start, then by end and list position."""
    return [F.col(lo).cast("bigint"), F.col(hi).cast("bigint"), F.floor(F.col(ord) / width).cast("bigint")]


def compress_ranges(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of consecutive integers: ``lo``, ``hi``, ``size`` and the text ``lo-hi``."""
    d = numbered(df.select(*keys, n).distinct(), keys, [n], "_rn", by_width(F.col(n), 1 << 20))
    runs = d.groupBy(*keys, (F.col(n) - F.col("_rn")).alias("_run")).agg(
        F.min(n).alias("lo"), F.max(n).alias("hi"), F.count(F.lit(1)).alias("size")
    )
    return runs.select(*keys, "lo", "hi", "size", span_text(F.col("lo"), F.col("hi")).alias("range"))


def sequence_gaps(df: DataFrame, keys: list[str], n: str, as_ranges: bool = False) -> DataFrame:
    """Numbers missing between the smallest and the largest of each key."""
    d = ordered_scan(
        df.select(*keys, n).distinct(), keys, [n], by_width(F.col(n), 1 << 20),
        previous={"_prev": F.col(n)},
    )
    gaps = d.where(F.col(n) > F.col("_prev") + 1).select(
        *keys, (F.col("_prev") + 1).cast("bigint").alias("gap_lo"), (F.col(n) - 1).cast("bigint").alias("gap_hi")
    )
    if as_ranges:
        return gaps
    chunk = 1 << 16
    parts = gaps.select("*", F.explode(F.sequence("gap_lo", "gap_hi", F.lit(chunk).cast("bigint"))).alias("_c"))
    return parts.select(
        *keys, F.explode(F.sequence("_c", F.least(F.col("_c") + chunk - 1, F.col("gap_hi")))).alias("missing")
    )


def overlaps(
    states: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", ord: str = "ord", running: bool = False
) -> DataFrame:
    """Intervals, sorted by (lo, hi), that start at or before the end of the one before.

    ``running=True`` compares with the furthest end so far instead of the row before.
    """
    kw = {"max_before" if running else "previous": {"prev_hi": F.col(hi)}}
    d = ordered_scan(states, keys, [lo, hi, ord], _span_blocks(lo, hi, ord), **kw)
    return d.where(F.col(lo) <= F.col("prev_hi"))


def _uncovered(holes: DataFrame, states: DataFrame, required: DataFrame, keys: list[str], pos: str, lo: str, hi: str) -> DataFrame:
    """Required positions in the ``holes`` (``_lo`` to ``_hi``) between the intervals of a key, before its first and behind its last."""
    usable = states.where(F.col(lo) <= F.col(hi))
    edge = usable.groupBy(*keys).agg(F.min(F.col(lo).cast("bigint")).alias("_min"), F.max(F.col(hi).cast("bigint")).alias("_max")).withColumns({
        "_first": required.agg(F.min(pos).cast("bigint")).scalar(), "_last": required.agg(F.max(pos).cast("bigint")).scalar()})
    head = F.struct(F.col("_first").alias("_lo"), F.least(F.col("_min") - 1, F.col("_last")).alias("_hi"))
    tail = F.struct(F.greatest(F.col("_max") + 1, F.col("_first")).alias("_lo"), F.col("_last").alias("_hi"))
    ends = edge.select(*keys, F.inline(F.array(head, tail))).where("_lo <= _hi")
    holes = cut_lineage(holes.unionByName(ends), "holes")
    return covering_pairs(required.select(pos).distinct(), holes, [], pos, "_lo", "_hi").select(*keys, pos)


def coverage_gaps(
    states: DataFrame, required: DataFrame, keys: list[str], pos: str, lo: str = "lo", hi: str = "hi", large: DataFrame | bool | None = True
) -> DataFrame:
    """Required positions that no interval of a key covers. Keys without any interval are skipped."""
    # an interval listed twice opens no hole the second time
    span = states.where(F.col(lo) <= F.col(hi)).select(
        *keys, F.col(lo).cast("bigint").alias("_lo"), F.col(hi).cast("bigint").alias("_hi")
    )
    d = ordered_scan(
        span, keys, ["_lo", "_hi"],
        [F.col("_lo"), F.floor(F.col("_hi") / 65536)],
        max_before={"_seen": F.col("_hi")}, large=large,
    )
    holes = d.where(F.col("_lo") > F.col("_seen") + 1).select(
        *keys, (F.col("_seen") + 1).alias("_lo"), (F.col("_lo") - 1).alias("_hi")
    )
    return _uncovered(holes, states, required, keys, pos, lo, hi)


def interval_errors(
    states: DataFrame, required: DataFrame, keys: list[str], pos: str,
    lo: str = "lo", hi: str = "hi", ord: str = "ord", large: DataFrame | bool | None = True,
) -> DataFrame:
    """Error rows: ``uncovered`` positions and ``overlap`` starts. Both are found in one scan, whose findings are stored."""
    a, b = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
    d = ordered_scan(states, keys, [lo, hi, ord], _span_blocks(lo, hi, ord), previous={"_before": F.col(hi)},
                     max_before={"_seen": F.when(F.col(lo) <= F.col(hi), b)}, large=large)
    crosses, hole = F.col(lo) <= F.col("_before"), (F.col(lo) <= F.col(hi)) & (a > F.col("_seen") + 1)
    found = d.where(crosses | hole).select(*keys, lo, hi, (F.col("_seen") + 1).alias("_lo"), F.coalesce(crosses, F.lit(False)).alias("_crosses"), F.coalesce(hole, F.lit(False)).alias("_hole"))
    found = cut_lineage(found, "found")
    holes = found.where("_hole").select(*keys, "_lo", (a - 1).alias("_hi"))
    missing = _uncovered(holes, states, required, keys, pos, lo, hi).select(
        *keys, F.lit("uncovered").alias("rule"), F.col(pos).cast("string").alias("detail")
    )
    crossing = found.where("_crosses").select(
        *keys, F.lit("overlap").alias("rule"), span_text(F.col(lo), F.col(hi)).alias("detail")
    )
    return missing.unionByName(crossing)


def normalise_states(
    states: DataFrame, keys: list[str], first: int, last: int,
    lo: str = "lo", hi: str = "hi", ord: str = "ord", large: DataFrame | bool | None = True,
) -> DataFrame:
    """Rebuild the intervals of each key so that they cover ``first..last`` without overlap.

    A position belongs to the interval that sorts first by (lo, hi, ord); gaps keep the state
    before them, the leading gap takes the first state; equal neighbours are joined. Keys with
    no usable interval keep their rows. Works on interval ends only, never on single positions.
    """
    usable = states.where((F.col(hi) >= first) & (F.col(lo) <= last) & (F.col(lo) <= F.col(hi)))
    d = usable.select(
        *keys,
        F.greatest(F.col(lo), F.lit(first)).cast("bigint").alias("_lo"),
        F.least(F.col(hi), F.lit(last)).cast("bigint").alias("_hi"),
        F.col(ord).alias("_ord"),
    )
    if large is True:
        large = large_keys(d, keys)
    # a scan of cut keys reads its input more than once, so each step then starts from stored rows; windows over whole keys follow each other
    stored = (lambda df: df) if large is None else cut_lineage
    d = ordered_scan(d, keys, ["_lo", "_hi", "_ord"], _span_blocks("_lo", "_hi", "_ord"), max_before={"_seen": F.col("_hi")}, large=large)
    owned = stored(d.select(
        *keys, "_ord", F.greatest(F.col("_lo"), F.coalesce(F.col("_seen") + 1, F.col("_lo"))).alias("_from"), "_hi"
    ).where(F.col("_from") <= F.col("_hi")))
    starts = ordered_scan(owned, keys, ["_from"], previous={"_before": F.col("_ord")}, large=large)
    starts = starts.where(F.col("_before").isNull() | (F.col("_before") != F.col("_ord")))
    starts = stored(starts.select(
        *keys, "_ord", F.when(F.col("_before").isNull(), F.lit(first)).otherwise(F.col("_from")).alias("_from"),
    ).withColumn("_back", -F.col("_from")))
    ends = ordered_scan(starts, keys, ["_back"], previous={"_next": F.col("_from")}, large=large)
    fixed = ends.select(
        *keys, F.col("_ord").alias(ord), F.col("_from").cast("bigint").alias(lo),
        (F.coalesce(F.col("_next") - 1, F.lit(last))).cast("bigint").alias(hi),
    )
    untouched = states.join(usable.select(*keys).distinct(), keys, "left_anti").select(
        *keys, ord, F.col(lo).cast("bigint").alias(lo), F.col(hi).cast("bigint").alias(hi)
    )
    return fixed.unionByName(untouched)


def repaired_keys(
    states: DataFrame, fixed: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", ord: str = "ord"
) -> DataFrame:
    """Keys whose interval list changed: bounds, number or listed order."""
    a = states.select(*keys, F.col(ord).alias("_o"), F.col(lo).cast("bigint").alias("_l"), F.col(hi).cast("bigint").alias("_h"))
    b = fixed.select(*keys, F.col(ord).alias("_o"), F.col(lo).cast("bigint").alias("_l"), F.col(hi).cast("bigint").alias("_h"))
    diff = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    changed = diff.groupBy(*keys, "_o", "_l", "_h").agg(F.sum("_side").alias("_d")).where("_d <> 0").select(*keys)
    turned = ordered_scan(b, keys, ["_l"], previous={"_p": F.col("_o")}).where(F.col("_p") > F.col("_o")).select(*keys)
    return changed.unionByName(turned).distinct()


def repair_states(
    states: DataFrame, required: DataFrame, keys: list[str], pos: str, first: int, last: int,
    lo: str = "lo", hi: str = "hi", ord: str = "ord",
) -> DataFrame:
    """Normalise the keys that fail :func:`interval_errors`; ``accepted`` tells if they pass now."""
    states = cut_lineage(states)  # read many times below
    large = large_keys(states, keys)  # normalising adds no rows to a key
    bad = cut_lineage(interval_errors(states, required, keys, pos, lo, hi, ord, large).select(*keys).distinct())
    failing = states.join(bad, keys, "left_semi")
    fixed = cut_lineage(normalise_states(failing, keys, first, last, lo, hi, ord, large))
    still = interval_errors(fixed, required, keys, pos, lo, hi, ord, large).select(*keys).distinct().withColumn("_still", F.lit(True))
    repaired = fixed.join(still, keys, "left").withColumn("accepted", F.col("_still").isNull()).drop("_still")
    kept = states.join(bad, keys, "left_anti").select(
        *keys, ord, F.col(lo).cast("bigint").alias(lo), F.col(hi).cast("bigint").alias(hi), F.lit(True).alias("accepted")
    )
    return repaired.unionByName(kept)
