"""Run ledger: upsert, outcomes, reports, cycles, telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .aggregates import strict_success
from .joins import resume


def upsert_ledger(ledger: DataFrame, updates: DataFrame, keys: list[str], ts: list[str], cols: list[str] = ("status", "data"), note: str = "note") -> DataFrame:
    """Latest write per key; the last note that was given is kept."""
    at = F.struct(*ts)
    d = ledger.unionByName(updates)
    last = F.max_by(F.struct(*cols, *ts), at)
    out = d.groupBy(*keys).agg(last.alias("_l"), F.max_by(note, F.when(F.col(note).isNotNull(), at)).alias(note))
    return out.select(*keys, *[F.col("_l")[c].alias(c) for c in cols], note, *[F.col("_l")[c].alias(c) for c in ts])


def stage_outcome(units: DataFrame, keys: list[str], status: str, lenient: bool = False) -> DataFrame:
    """completed or failed per stage, with a note on what is open."""
    d = strict_success(units, keys, status, lenient)
    note = F.when(~F.col("ok"), F.concat(F.col("open_units").cast("string"), F.lit(" of "), F.col("units").cast("string"), F.lit(" not completed")))
    return d.select(*keys, F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), note.alias("note"))


def run_report(ledger: DataFrame, keys: list[str], item: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Per stage: ok, items, open items; and the open items as rows."""
    d = strict_success(ledger, keys, status)
    return d, ledger.where(F.coalesce(F.col(status), F.lit("")) != "completed").select(*keys, item, status)


def retry_cycles(
    todo: DataFrame, keys: list[str], run: Callable[[DataFrame, int], DataFrame], max_cycles: int = 5
) -> tuple[DataFrame, int]:
    """Run open units again until all are completed or the cycles are used up.

    ``run(units, cycle)`` returns the keys, ``status`` and ``ok`` (output written). Only the loop
    and an emptiness test run on the driver.
    """
    results, cycle = None, 0
    open_units = todo
    for cycle in range(1, max_cycles + 1):
        now = cut_lineage(run(open_units, cycle).withColumn("cycle", F.lit(cycle)))
        results = now if results is None else results.unionByName(now)
        open_units = resume(open_units, now, now.where("ok"), keys)
        if open_units.isEmpty():
            break
    return results, cycle


def telemetry_snapshot(events: DataFrame, keys: list[str | Column], busy: Column, capacity: int, kind: str, kinds: list[str]) -> DataFrame:
    """Busy share of the capacity, queue and counts per kind in each group."""
    d = events.groupBy(*keys).agg(
        F.count_if(busy).alias("busy"), F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])
    return d.withColumns({
        "utilisation_pct": F.least(F.col("busy"), F.lit(capacity)) * 100.0 / capacity, "queued": F.greatest(F.col("busy") - capacity, F.lit(0)).cast("bigint")})
