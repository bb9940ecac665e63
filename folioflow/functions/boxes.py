"""Box geometry and aspect."""

from pyspark.sql import Column, functions as F

from . import fixed


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def pixel(c: Column) -> Column:
    """Nearest pixel, ties to even."""
    return F.rint(c).cast("int")


def shape_of(w: Column, h: Column) -> Column:
    """Shape by aspect; null without a usable width and height."""
    aspect = F.when((w > 0) & (h > 0), F.try_divide(w, h))
    return (
        F.when(aspect.isNull(), F.lit(None).cast("string"))
        .when(aspect < fixed.ASPECT_LOW, "vertical")
        .when(aspect > fixed.ASPECT_HIGH, "horizontal")
        .otherwise("square")
    )


def bucket_side(bucket: Column, side: int) -> Column:
    """Width (0) or height (1) of a size bucket."""
    out = F.lit(None).cast("int")
    for name, dims in fixed.SIZE_BUCKETS.items():
        out = F.when(bucket == name, F.lit(dims[side])).otherwise(out)
    return out
