"""Roll-ups. Each one combines on the map side and keeps a bounded state per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.seeds import score
from ..functions.text import gender, unit_path
from .scan import numbered, ordered_scan




def _rows() -> Column:
    return F.count(F.lit(1))


def manifest_rollup(df: DataFrame, keys: list[str], flagged: Column, number: str) -> DataFrame:
    """Number of items, of flagged ones, and the range of their numbers."""
    return df.groupBy(*keys).agg(
        _rows().alias("n"), F.count_if(flagged).alias("n_flagged"), F.min(number).alias("first"), F.max(number).alias("last"))


def item_status_counts(df: DataFrame, keys: list[str], status: str, rollup: bool = False) -> DataFrame:
    """Counts per key and status; with ``rollup`` also the totals of each level."""
    g = df.rollup(*keys, status) if rollup else df.groupBy(*keys, status)
    return g.agg(_rows().alias("n"))


def item_status_wide(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One column per status value."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], _rows().alias("total"))


def check_rollup(df: DataFrame, keys: list[str], initial: str, final: str) -> DataFrame:
    """Units that passed at once, passed after repair, or stay unresolved."""
    return df.groupBy(*keys).agg(
        F.count_if((F.col(initial) == 0) & (F.col(final) == 0)).alias("passed"),
        F.count_if((F.col(initial) > 0) & (F.col(final) == 0)).alias("repaired"),
        F.count_if(F.col(final) > 0).alias("unresolved"))


def unresolved_units(df: DataFrame, final: str) -> DataFrame:
    """The unresolved units as rows, however many there are."""
    return df.where(F.col(final) > 0)


def accepted(passed: str, points: str) -> Column:
    """A verdict counts only with a pass and enough points; a broken verdict has neither."""
    return F.coalesce(F.col(passed), F.lit(False)) & (score(F.col(points)) >= fixed.PASS_SCORE)


def final_attempt(attempts: DataFrame, unit: list[str], attempt: str, passed: str, points: str, infra: str | None = None) -> DataFrame:
    """Outcome per unit, from its attempts in order up to the one that closes it; what comes later does not count.

    An accepted attempt completes the unit, an infrastructure error fails it, and three rejected attempts need
    review. ``final_attempt`` is the last attempt that counts and ``best_attempt`` the best-scored of these;
    errors are no attempts. Of attempts with one number a failed, low-scored one comes first.
    """
    a, s = F.col(attempt), score(F.col(points))
    broke = F.coalesce(F.col(infra), F.lit(False)) if infra else F.lit(False)
    d = attempts.select(*unit, a.alias("_a"), s.alias("_s"), broke.alias("_broke"), accepted(passed, points).alias("_ok"), F.coalesce(F.col(passed), F.lit(False)).alias("_p"))
    # a unit is closed after three rows at most, so only these leave the map side
    w = Window.partitionBy(*unit).orderBy("_a", "_p", "_s", "_broke")
    d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= fixed.MAX_ATTEMPTS)
    row = F.struct("_n", "_a", "_s", "_broke", "_ok")
    d = d.groupBy(*unit).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    closing = F.array_min(F.transform(F.filter("_rows", lambda r: r["_broke"] | r["_ok"]), lambda r: r["_n"]))
    d = d.withColumn("_rows", F.slice("_rows", 1, F.coalesce(closing, F.lit(fixed.MAX_ATTEMPTS))))
    end, real = F.element_at("_rows", -1), F.filter("_rows", lambda r: ~r["_broke"])
    last, n = F.try_element_at(real, F.lit(-1)), F.size(real).cast("bigint")
    best = F.array_max(F.transform(real, lambda r: F.struct(r["_s"].alias("s"), (-r["_a"]).alias("n"))))
    status = (
        F.when(end["_broke"], "failed").when(end["_ok"], "completed")
        .when(n >= fixed.MAX_ATTEMPTS, "needs_review").otherwise("pending"))
    return d.select(
        *unit, n.alias("n_attempts"), last["_a"].alias("final_attempt"), (-best["n"]).alias("best_attempt"),
        last["_s"].alias("final_score"), status.alias("status"))


def attempt_qc(outcomes: DataFrame) -> DataFrame:
    """Health figures over the outcomes of :func:`final_attempt`, with range flags."""
    d = outcomes.where("n_attempts > 0").agg(
        _rows().alias("units"),
        (F.count_if((F.col("status") == "completed") & (F.col("final_attempt") == 0)) / _rows()).alias("first_pass_rate"),
        (F.sum("n_attempts") / _rows()).alias("mean_attempts"),
        (F.count_if(F.col("status") == "needs_review") / _rows()).alias("review_rate"),
        (F.sum("final_score") / _rows()).alias("mean_score"))
    return d.withColumns({
        "first_pass_ok": F.col("first_pass_rate") >= fixed.FIRST_PASS_MIN,
        "attempts_ok": F.col("mean_attempts") <= fixed.MEAN_ATTEMPTS_MAX,
        "review_ok": F.col("review_rate") <= fixed.REVIEW_MAX, "score_ok": F.col("mean_score") >= fixed.SCORE_MIN})


def count_text(girls: Column, boys: Column) -> Column:
    """``1girl, 2boys`` style tag of two counts, ``no humans`` if both are zero or null."""
    def part(n, word):
        return F.when(n == 1, F.lit("1" + word)).when(n > 1, F.concat(n.cast("string"), F.lit(word + "s")))

    tag = F.concat_ws(", ", part(girls, "girl"), part(boys, "boy"))
    return F.when(tag == "", "no humans").otherwise(tag)


def count_tag(members: DataFrame, keys: list[str], sex: str) -> DataFrame:
    """``1girl, 2boys`` style tag of a group, ``no humans`` if neither."""
    g = gender(F.col(sex))
    d = members.groupBy(*keys).agg(F.count_if(g == "female").alias("_f"), F.count_if(g == "male").alias("_m"))
    return d.select(*keys, count_text(F.col("_f"), F.col("_m")).alias("count_tag"))


def attribute_conflicts(df: DataFrame, key: list[str], attr: str) -> DataFrame:
    """Keys whose records disagree on an attribute; null counts as empty."""
    v = F.coalesce(F.col(attr), F.lit(""))
    return df.groupBy(*key).agg(F.min(v).alias("least"), F.max(v).alias("greatest")).where("least <> greatest").select(*key)


def ordered_concat(
    df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str = "\n", part_rows: int = 1000, blocks: list[Column] | None = None
) -> DataFrame:
    """Text of a group in order. A group of more than ``part_rows`` lines gives several numbered parts."""
    d = numbered(df.withColumn("_line", line).select(*keys, *order, "_line"), keys, order, "_rn", blocks)
    part = F.floor((F.col("_rn") - 1) / part_rows).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("_rn", "_line")))
    return d.groupBy(*keys, part.alias("part")).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), sep).alias("text"))


def latency_profile(df: DataFrame, keys: list[str], value: str, step: float = 1.0, exact: bool = True) -> DataFrame:
    """Count, median, P90 and maximum. Exact values come from running counts of the distinct
    values, so no group has to fit into one task; ``exact=False`` uses quantile sketches."""
    if not exact:
        q = F.percentile_approx(value, [0.5, 0.9], 10000)
        return df.groupBy(*keys).agg(_rows().alias("n"), q[0].alias("median"), q[1].alias("p90"), F.max(value).alias("max"))
    d = df.where(F.col(value).isNotNull())
    counts = d.groupBy(*keys, value).agg(_rows().alias("_c"))
    run = ordered_scan(counts, keys, [value], [F.floor(F.col(value) / step).cast("bigint")], sums={"_before": F.col("_c")})
    total = d.groupBy(*keys).agg(_rows().alias("n"), F.max(value).alias("max"))
    run = run.join(total, keys)
    upto, n = F.col("_before") + F.col("_c"), F.col("n")
    aggs = []
    for name, q in [("median", 0.5), ("p90", 0.9)]:
        h = (n - 1) * F.lit(q)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.min(F.when(upto > lo, F.col(value))).alias(f"_{name}_lo"), F.min(F.when(upto > hi, F.col(value))).alias(f"_{name}_hi"),
                 F.max(h - lo).alias(f"_{name}_w"), F.max(hi - h).alias(f"_{name}_v")]
    out = run.groupBy(*keys, "n", "max").agg(*aggs)

    def between(x):
        lo, hi = F.col(f"_{x}_lo"), F.col(f"_{x}_hi")
        return F.when(lo == hi, lo).otherwise(F.col(f"_{x}_v") * lo + F.col(f"_{x}_w") * hi).alias(x)

    mix = [between("median"), between("p90")]
    return out.select(*keys, "n", *mix, "max")


def sketch_error(size: int) -> float:
    """Largest distance, as a share of all rows, between the rank asked for and the rank of the answer of
    a sketch of that size, with 99 % confidence (published fit for this kind of sketch)."""
    return 2.296 / size ** 0.9723


def latency_sketches(df: DataFrame, keys: list[str], value: str, size: int = 2000) -> DataFrame:
    """Count, maximum and a mergeable quantile sketch of the values of each group; null and not-a-number are left out.

    A sketch takes some kilobytes however many rows it stands for, so sketches of hours or parts can be
    stored and merged into those of days or of the whole by ``latency_from_sketches``."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        _rows().alias("n"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def latency_from_sketches(sketches: DataFrame, keys: list[str], size: int = 2000, rollup: bool = False) -> DataFrame:
    """Count, median, P90 and maximum of stored sketches merged over ``keys``; the answers are values of the group
    whose rank is off by at most ``sketch_error(size)``.

    ``rollup=True`` adds the totals of each leading part of ``keys``; ``level`` has a bit set for each key that
    a row sums over (the last key is bit 0)."""
    grouped = sketches.rollup(*keys) if rollup else sketches.groupBy(*keys)
    level = [F.grouping_id().alias("level")] if rollup else []
    d = grouped.agg(*level, F.sum("n").alias("n"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_s"))
    median, p90 = (F.kll_sketch_get_quantile_double("_s", F.lit(q)) for q in (0.5, 0.9))
    return d.select(*keys, *[c for c in ("level",) if rollup], "n", median.alias("median"), p90.alias("p90"), "max")


def stage_benchmark(base: DataFrame, run: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Seconds per stage of two runs, reduction in percent and share of the total."""
    def per(df, name):
        return df.groupBy(stage).agg(F.sum(F.col(seconds).cast("decimal(18,2)")).cast("double").alias(name))

    d = per(base, "base_seconds").join(per(run, "run_seconds"), stage, "full_outer")
    total = run.agg(F.sum(F.col(seconds).cast("decimal(18,2)")).cast("double").alias("_t")).scalar()
    return d.withColumn("_t", total).select(
        stage, "base_seconds", "run_seconds",
        F.try_divide((F.col("base_seconds") - F.col("run_seconds")) * 100, F.col("base_seconds")).alias("reduction_pct"),
        F.try_divide(F.col("run_seconds") * 100, F.col("_t")).alias("share_pct"))


def render_rate(jobs: DataFrame, keys: list[str], wall: str, output: str) -> DataFrame:
    """Wall seconds, output seconds and their ratio."""
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return jobs.groupBy(*keys).agg(_rows().alias("jobs"), total(wall).alias("wall_seconds"), total(output).alias("output_seconds")).withColumn(
        "seconds_per_second", F.try_divide("wall_seconds", "output_seconds"))


def merge_entities(chunks: DataFrame, entity: str, order: list[str], attrs: list[str]) -> DataFrame:
    """One row per entity over all chunks: the attributes it was first seen with."""
    first = F.min(F.struct(*order, *attrs))
    return chunks.groupBy(entity).agg(first.alias("_f"), _rows().alias("n_mentions")).select(
        entity, *[F.col("_f")[a].alias(a) for a in attrs], "n_mentions")


def merge_states(chunks: DataFrame, entity: str, order: list[str], state_cols: list[str], blocks=None) -> DataFrame:
    """States of an entity from all chunks in chunk order, numbered from 1."""
    return numbered(chunks.select(entity, *order, *[c for c in state_cols if c not in order]), [entity], order, "state_ord", blocks)


def issues_by_file(issues: DataFrame, file: str, problem: str) -> DataFrame:
    """Issues per file, file names in one spelling."""
    return issues.groupBy(unit_path(F.col(file)).alias("file")).agg(
        _rows().alias("n_issues"), F.min(problem).alias("first_problem"))


def opposite_text(female: Column, male: Column) -> Column:
    """List against mix-ups if only one of the two occurs, else null."""
    return F.when(female & ~male, ", ".join(fixed.EXCLUDE_WHEN_FEMALE)).when(male & ~female, ", ".join(fixed.EXCLUDE_WHEN_MALE))


def exclusive_negatives(members: DataFrame, keys: list[str], sex: str, base: Column | None = None) -> DataFrame:
    """Groups of one kind only get the opposite list; mixed groups and groups of neither get none."""
    g = gender(F.col(sex))
    d = members.groupBy(*keys).agg(F.bool_or(g == "female").alias("_f"), F.bool_or(g == "male").alias("_m"))
    own = opposite_text(F.col("_f"), F.col("_m"))
    return d.select(*keys, F.concat_ws(", ", own, *([] if base is None else [base])).alias("negative"))


def script_ratio(lines: DataFrame, keys: list[str], text: str, pattern: str, threshold: float = 0.8) -> DataFrame:
    """Share of lines that match a script, and whether it reaches the threshold."""
    d = lines.groupBy(*keys).agg((F.count_if(F.col(text).rlike(pattern)) / _rows()).alias("ratio"))
    return d.withColumn("reached", F.col("ratio") >= threshold)


def media_consistency(media: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Do all clips share size, rate, layout, frame rate (within .01 of the first) and have sound;
    canvas = first clip near 16:9, else the first clip."""
    at = F.struct(*order)
    wide = (F.col("w") > 0) & (F.col("h") > 0) & (F.abs(F.col("w") / F.col("h") - 16 / 9) < 0.1)
    size = F.struct("w", "h", "fps")
    same = [F.min(c) == F.max(c) for c in ("w", "h", "sample_rate", "channels")]
    all_same = same[0] & same[1] & same[2] & same[3]
    d = media.groupBy(*keys).agg(
        _rows().alias("clips"), all_same.alias("_same"), F.bool_and("has_audio").alias("_audio"),
        F.min("fps").alias("_f0"), F.max("fps").alias("_f1"),
        F.min(F.struct(at.alias("o"), size.alias("s")))["s"].alias("_first"),
        F.min(F.when(wide, F.struct(at.alias("o"), size.alias("s"))))["s"].alias("_wide"))
    fps = F.col("_first.fps")
    ok = F.col("_same") & F.col("_audio") & (F.col("_f1") - fps < 0.01) & (fps - F.col("_f0") < 0.01)
    return d.select(*keys, "clips", ok.alias("consistent"), F.coalesce("_wide.w", "_first.w").alias("canvas_w"), F.coalesce("_wide.h", "_first.h").alias("canvas_h"))


def strict_success(units: DataFrame, keys: list[str], status: str, lenient: bool = False) -> DataFrame:
    """Is a stage done: every unit completed, or (lenient) at least one completed or under review."""
    ok = F.bool_or(F.col(status).isin("completed", "needs_review")) if lenient else F.bool_and(F.coalesce(F.col(status), F.lit("")) == "completed")
    return units.groupBy(*keys).agg(ok.alias("ok"), _rows().alias("units"), F.count_if(F.coalesce(F.col(status), F.lit("")) != "completed").alias("open_units"))


def call_accounting(log: DataFrame, keys: list[str], baseline: DataFrame | None = None) -> DataFrame:
    """Successful calls, failed attempts and mean seconds from parsed log lines; the two counts less a baseline."""
    d = log.groupBy(*keys).agg(
        F.count("ok_seconds").alias("ok_calls"), F.count_if("failed").alias("failed_attempts"),
        (F.sum(F.col("ok_seconds").cast("decimal(18,3)")).cast("double") / F.greatest(F.count("ok_seconds"), F.lit(1))).alias("mean_ok_seconds"))
    if baseline is None:
        return d
    b = baseline.select(*keys, F.col("ok_calls").alias("_o"), F.col("failed_attempts").alias("_f"))
    zero = F.lit(0)
    return d.join(b, keys, "left").select(
        *keys, (F.col("ok_calls") - F.coalesce("_o", zero)).alias("ok_calls"),
        (F.col("failed_attempts") - F.coalesce("_f", zero)).alias("failed_attempts"), "mean_ok_seconds")
