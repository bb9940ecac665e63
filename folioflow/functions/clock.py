"""Clock strings and seconds."""

from pyspark.sql import Column, functions as F

from .text import let


def clock_seconds(c: Column) -> Column:
    """``HH:MM:SS.ff`` or ``MM:SS.mmm`` -> seconds as double; null if malformed."""
    def seconds(parts):
        part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
        return F.when(F.size(parts) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(parts) == 2, part(1) * 60 + part(2))

    return let(F.split(F.when(c.rlike(r"^\d+:(\d+:)?\d+(\.\d+)?$"), c), ":"), seconds)


def shot_clock(seconds: Column) -> Column:
    """Seconds -> ``MM:SS.mmm``."""
    ms = F.rint(seconds * 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d.%03d",
        F.floor(ms / 60000).cast("bigint"),
        F.pmod(F.floor(ms / 1000).cast("bigint"), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )
