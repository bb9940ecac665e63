"""Reproducible seeds from md5."""

from pyspark.sql import Column, functions as F

from . import fixed


def seed32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def seed64(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 16), 16, 10).cast("decimal(20,0)")


def retry_seed(seed: Column, attempt: Column) -> Column:
    return seed + attempt * fixed.SEED_STEP


def score(c: Column) -> Column:
    """Integer score in 0..10, cut to a whole number; anything that is not a number counts as 0."""
    n = F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))
    return F.least(F.lit(fixed.MAX_SCORE), F.greatest(F.lit(0), n))
