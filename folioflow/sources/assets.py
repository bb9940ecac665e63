"""Numbered page assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed


def list_assets(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files under a folder; the content is read only on request."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df if content else df.select("path", "modificationTime", "length")


def numbered_assets(df: DataFrame, path: str = "path", exts: list[str] = fixed.ASSET_EXTS) -> DataFrame:
    """Files of an allowed type whose stem holds digits; number = last digit group of the stem."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(F.col("file"), r"\.([^.]+)$", 1))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    number = F.regexp_extract(stem, r"(\d+)\D*$", 1).try_cast("bigint")
    return (
        df.withColumn("file", file)
        .withColumns({"dir": F.regexp_replace(path, r"/[^/]*$", ""), "ext": ext, "number": number})
        .where(F.col("ext").isin(exts) & F.col("number").isNotNull())
    )


def pick_asset_root(assets: DataFrame, dir: str = "dir") -> DataFrame:
    """The deepest folder; of equals the one with most files; then the smallest name."""
    per_dir = assets.groupBy(dir).agg(F.count(F.lit(1)).alias("n"))
    depth = F.length(dir) - F.length(F.replace(F.col(dir), F.lit("/"), F.lit("")))
    best = F.min(F.struct((-depth).alias("d"), (-F.col("n")).alias("m"), F.col(dir).alias("dir")))
    return per_dir.agg(best.alias("_b")).select(
        F.col("_b.dir").alias("dir"), (-F.col("_b.d")).alias("depth"), (-F.col("_b.m")).alias("n")
    )


def png_size(df: DataFrame, content: str = "content") -> DataFrame:
    """Width and height from the fixed places of a PNG header; null for other files."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"  # fixed value: file signature
    def number(at):
        return F.when(is_png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).try_cast("int"))
    return df.withColumns({"w": number(17), "h": number(21)})
