"""Position intervals written as text, e.g. ``1-3,5``."""

from pyspark.sql import Column, functions as F

_LENIENT = r"^(\d+)\s*(?:[-–~—]\s*(\d+))?$"
_STRICT = r"^([+-]?\d+)$|^(\d+)\s*-\s*([+-]?\d+)$"
_TYPE = "array<struct<lo:int,hi:int>>"


def parse_spans(c: Column, strict: bool = False) -> Column:
    """Array of ``struct<lo,hi>``.

    Lenient: bad parts are skipped and reversed bounds swapped. Strict: one bad part makes
    the whole value null, and bounds stay as written.
    """
    from .text import strip

    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda p: p != "")
    if strict:
        def one(p):
            single = F.regexp_extract(p, _STRICT, 1)
            lo = F.when(single != "", single).otherwise(F.regexp_extract(p, _STRICT, 2))
            hi = F.when(single != "", single).otherwise(F.regexp_extract(p, _STRICT, 3))
            return F.struct(lo.try_cast("int").alias("lo"), hi.try_cast("int").alias("hi"))

        out = F.transform(parts, one)
        bad = F.exists(out, lambda s: s["lo"].isNull() | s["hi"].isNull())
        return F.when(~bad & (F.size(out) > 0), out).cast(_TYPE)

    def pair(p):
        a = F.regexp_extract(p, _LENIENT, 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(p, _LENIENT, 2).try_cast("int"), a)
        return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    return F.transform(F.filter(parts, lambda p: p.rlike(_LENIENT)), pair).cast(_TYPE)


def has_span(c: Column) -> Column:
    """Does the text hold at least one interval? One pattern match, without parsing."""
    return F.coalesce(c, F.lit("")).rlike(r"(^|,)\s*\d+\s*(?:[-–~—]\s*\d+)?\s*(,|$)")


def span_text(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))
    )
