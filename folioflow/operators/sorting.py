"""Orders, next steps and short extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from .scan import table_order


def natural_order(df: DataFrame, number: str, name: str, tie: str, out: str = "pos") -> DataFrame:
    """Dense position by (number, name, tie) over the whole table; ``tie`` is a number."""
    return table_order(df, number, [name, tie], out, [F.col(name), F.floor(F.col(tie) / 65536)])


def _stage_rank(stage: Column, stages: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), stage)
    return F.when(at > 0, at)


def next_pending(ledger: DataFrame, run: str, stage: str, status: str, stages: list[str] = fixed.STAGES) -> DataFrame:
    """Per run the first stage, in order, that is not completed; null when all are.

    A stage without a row counts as pending.
    """
    done = F.array_agg(F.when(F.col(status) == "completed", F.col(stage)))  # at most one per stage
    d = ledger.select(run, stage, status).distinct().groupBy(run).agg(F.array_distinct(done).alias("_done"))
    left = F.filter(F.array(*[F.lit(s) for s in stages]), lambda s: ~F.array_contains("_done", s))
    return d.select(run, F.try_element_at(left, F.lit(1)).alias("next_stage"))


def tail(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Last n rows per key. Spark keeps only n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def closest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Per prefix the number of names that start with it and the shortest one (then the first).

    Names and prefixes meet by equality on the cut name, one probe per prefix length in use.
    """
    # at most one entry per possible length, so the set stays small
    sizes = prefixes.agg(F.collect_set(F.length(prefix)).alias("_n")).scalar()
    cut = names.select(name).withColumn("_sizes", sizes)
    cut = cut.select(name, F.explode(F.filter("_sizes", lambda n: n <= F.length(name))).alias("_n")).select(
        F.col(name), F.substring(name, F.lit(1), F.col("_n")).alias("_p"))
    per = cut.groupBy("_p").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.min(F.struct(F.length(name).alias("l"), F.col(name).alias("v"))).alias("_b"))
    return prefixes.join(per, F.col(prefix) == F.col("_p"), "left").select(
        prefix, F.coalesce("n_names", F.lit(0)).cast("bigint").alias("n_names"), F.col("_b.v").alias("closest"))


def stage_strip(ledger: DataFrame, run: str, stage: str, status: str, stages: list[str] = fixed.STAGES) -> DataFrame:
    """One letter per stage in order; a stage without a row is pending, an unknown status ``?``."""
    letter = F.lit("?")
    for word, mark in fixed.STATUS_LETTERS.items():
        letter = F.when(F.col(status) == word, F.lit(mark)).otherwise(letter)
    cells = [F.coalesce(F.max(F.when(F.col(stage) == s, letter)), F.lit(".")) for s in stages]
    return ledger.groupBy(run).agg(F.concat(*cells).alias("strip"))
