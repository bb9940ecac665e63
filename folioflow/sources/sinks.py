"""Writers that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_idempotent(df: DataFrame, path: str, unit_cols: list[str]) -> None:
    """Replace only the units (partitions) present in ``df``; the commit protocol hides partial files."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*unit_cols).parquet(path)
    )


def report_lines(units: DataFrame, unit: str, initial: str, final: str, rounds: str) -> DataFrame:
    """One line per unit: PASS, REPAIRED (n rounds) or UNRESOLVED."""
    verdict = check_verdict(F.col(initial), F.col(final))
    text = F.when(verdict == "repaired", F.concat(F.lit("REPAIRED ("), F.col(rounds).cast("string"), F.lit(")")))
    return units.select(
        F.col(unit), verdict.alias("verdict"),
        F.concat(F.lit("- "), F.col(unit).cast("string"), F.lit(": "), F.coalesce(text, F.upper(verdict))).alias("line"),
    )


def check_verdict(initial, final):
    return F.when(final > 0, "unresolved").when(initial > 0, "repaired").otherwise("pass")


def write_report(units: DataFrame, path: str, unit: str, initial: str, final: str, rounds: str) -> DataFrame:
    """Write the report lines as text files and return the totals."""
    lines = report_lines(units, unit, initial, final, rounds)
    lines.select("line").write.mode("overwrite").text(path)
    return lines.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
