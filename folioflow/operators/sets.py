"""Set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tag_set, tokens, unweight
from ..session import cut_lineage
from .scan import numbered


def missing_tags(required: Column, present: Column) -> Column:
    """Required tags, as written, whose plain form the present tags lack."""
    have = tag_set(present)
    return F.filter(tokens(required), lambda t: ~F.array_contains(have, F.lower(unweight(t))))


def required_tokens_missing(df: DataFrame, appearance: str, state: str, present: str, out: str = "missing") -> DataFrame:
    need = F.concat_ws(",", appearance, state)
    return df.withColumn(out, missing_tags(need, F.col(present)))


def exact_cover(used: DataFrame, units: DataFrame, keys: list[str], unit: str, order: list[str], unit_order: list[str], blocks=None, unit_blocks=None) -> DataFrame:
    """Units missing from, used twice in or unknown to a segmentation, and units out of order.

    A unit is out of order when its place among the used ones differs from its place among the
    known ones (both counted over units that occur exactly once on each side).
    """
    n_used = used.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n_used"))
    known = units.select(*keys, unit).distinct().withColumn("_known", F.lit(True))
    d = cut_lineage(n_used.join(known, [*keys, unit], "full_outer"), "cover")  # read for the errors and for both orders
    problem = F.when(F.col("n_used").isNull(), "missing").when(F.col("_known").isNull(), "unknown").when(F.col("n_used") > 1, "duplicate")
    wrong = d.select(*keys, unit, problem.alias("problem")).where("problem IS NOT NULL")
    single = d.where("n_used = 1 AND _known").select(*keys, unit)
    a = numbered(used.join(single, [*keys, unit], "left_semi"), keys, order, "_a", blocks).select(*keys, unit, "_a")
    b = numbered(units.join(single, [*keys, unit], "left_semi"), keys, unit_order, "_b", unit_blocks).select(*keys, unit, "_b")
    moved = a.join(b, [*keys, unit]).where("_a <> _b").select(*keys, unit, F.lit("order").alias("problem"))
    return wrong.unionByName(moved)


def residual_issues(new: DataFrame, carried: DataFrame, on: list[str] = ("file", "problem")) -> DataFrame:
    """New issues that are not carried over already, and the carried ones."""
    return new.join(carried, list(on), "left_anti").unionByName(carried)


def recheck_scope(units: DataFrame, run: str, changed_runs: DataFrame, revised: DataFrame, unit: str) -> DataFrame:
    """All units of a run whose shared settings changed, else its revised units."""
    whole = units.join(changed_runs, run, "left_semi")
    rest = units.join(changed_runs, run, "left_anti").join(revised, [run, unit], "left_semi")
    return whole.unionByName(rest).distinct()
