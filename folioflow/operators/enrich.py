"""Calls of user-supplied functions, spread by Spark. Only these operators run Python per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage


def enrich(
    df: DataFrame, call: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], out_schema: str, validate: Callable[[pd.DataFrame], pd.Series],
    max_attempts: int = 2, lanes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of a batch function, e.g. a model client.

    ``call(rows, errors)`` returns the columns of ``out_schema`` for each row; ``errors`` holds the
    messages of the attempt before ('' at first). ``validate(result)`` gives a list of messages per
    row. Only rows with messages are tried again. ``lanes`` caps the number of parallel calls.
    Where a call or its validation raises an exception, the rows are halved until the rows that cause it are alone;
    these have the exception as their message, so they are tried again and quarantined, and all others are kept.
    The result is stored once, so that no call is repeated when both parts are read.
    """
    cols = df.columns
    out_cols = [c.split()[0].strip(":") for c in out_schema.split(",")]

    def attempt(rows: pd.DataFrame, errors: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
        try:
            got = call(rows, errors)[out_cols].set_axis(rows.index)
            return got.astype(object), validate(got).set_axis(rows.index)
        except Exception as e:  # noqa: BLE001 - whatever the caller's function raises belongs to its rows
            if len(rows) < 2:
                return pd.DataFrame(None, rows.index, out_cols, dtype=object), pd.Series([[f"{type(e).__name__}: {e}"]] * len(rows), rows.index, dtype=object)
            half = len(rows) // 2
            parts = [attempt(rows.iloc[a:b], errors.iloc[a:b]) for a, b in ((0, half), (half, len(rows)))]
            return pd.concat([g for g, _ in parts]), pd.concat([m for _, m in parts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.reset_index(drop=True)
            result = pd.DataFrame(index=rows.index, columns=out_cols, dtype=object)
            errors = pd.Series([""] * len(rows), index=rows.index, dtype=object)
            attempts = pd.Series(0, index=rows.index)
            left = rows.index
            for _ in range(max_attempts):
                got, messages = attempt(rows.loc[left], errors.loc[left])
                result.loc[left] = got
                attempts.loc[left] += 1
                errors.loc[left] = messages.map("; ".join)
                left = left[messages.map(len).to_numpy() > 0]
                if len(left) == 0:
                    break
            yield pd.concat([rows, result, pd.DataFrame({"attempts": attempts, "error": errors})], axis=1)

    source = df.repartition(lanes) if lanes else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    done = cut_lineage(source.mapInPandas(run, f"{schema}, {out_schema}, attempts int, error string"))
    good = done.where("error = ''").drop("error")
    return good, done.where("error <> ''").select(*cols, "attempts", "error")


def sequential_chain(
    df: DataFrame, keys: list[str], order: list[str], step: Callable[[object, dict], object], out: str, out_type: str = "string"
) -> DataFrame:
    """``out`` of a row = ``step(out of the row before in the key, row)``; None before the first.

    A chain depends on its own past, so one key is one sequence; rows stream through in sorted
    batches and only the last output is held, however long the chain is. Where the step needs the
    row before but not its output, use the window operators.
    """
    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for rows in batches:
            outs = []
            for row in rows.to_dict("records"):
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, last = now, None
                last = step(last, row)
                outs.append(last)
            rows[out] = outs
            yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    d = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return d.mapInPandas(run, f"{schema}, `{out}` {out_type}").select(*cols, out)


def register_sections(spark: SparkSession, name: str = "sections") -> None:
    """SQL table function ``sections(text)`` -> (ord, heading, body), as a SQL function on the JVM."""
    spark.sql(rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING)
        RETURNS TABLE (ord INT, heading STRING, body STRING)
        RETURN SELECT pos, IF(pos = 0, '', regexp_replace(substring_index(part, '\n', 1), '^\\s+|\\s+$', '')),
          regexp_replace(CASE WHEN pos = 0 THEN part WHEN contains(part, '\n') THEN regexp_replace(part, '^[^\\n]*\\n', '') ELSE '' END, '^\\s+|\\s+$', '')
        FROM (SELECT posexplode(split(concat('\n', txt), '\n## ')) AS (pos, part))""")
