"""Mixing groups of prompts to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: a rate above this is drawn as a sum of Poisson counts of smaller rates
PART = 32.0


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) with 52 bits out of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Distribution function of a Poisson count at 0, 1, ..., up to where it is 1 in doubles."""
    end = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct((-rate).alias("l"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a"))

    def step(acc, k):
        l = acc["l"] + F.ln(rate) - F.ln(k.cast("double"))
        c = acc["c"] + F.exp(l)
        return F.struct(l.alias("l"), c.alias("c"), F.concat(acc["a"], F.array(c)).alias("a"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), end), first, step, lambda acc: acc["a"])).otherwise(F.array(F.lit(1.0)))


def mix_prompts(
    prompts: DataFrame, key: str = "panel", group: str = "size_bucket", weights: dict[str, float] | None = None, power: float = 0.5,
    total: float | None = None, seed: int = 17,
) -> DataFrame:
    """A mixture of about ``total`` prompts (default: as many as there are) in which groups have target weights.

    ``weights`` names the weight of each group; a group that it does not name gets none. Without it a group
    of n prompts weighs n to the ``power``. The mean number of copies of a prompt is weight * total / n, and
    its own number is the Poisson count of that mean at a uniform number hashed from seed and key, so a
    rerun gives the same mixture. A mean above 32 is drawn in equal parts of at most 32.

    Returns the columns of ``prompts`` with ``copy`` (1, 2, ...) and ``shuffle_key``, in the order of the
    latter, a hash of seed, key and copy: a global shuffle. Columns of these two names are replaced.
    Only counts per group are gathered; the table of rates goes to the rows as its size allows.

    A null group is a group like others (in ``weights`` its name is None). Rows of one key draw the same number;
    null keys count as an empty text. An empty table gives an empty mixture.
    """
    counts = cut_lineage(prompts.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n")), "counts")
    weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    if weights is not None:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_g").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sums = counts.agg(F.sum("n").alias("n"), F.sum(weight).alias("w")).first()
    aim = float(total if total is not None else sums["n"] or 0)
    rate = weight / F.lit(float(sums["w"] or 1)) * aim / F.col("n")
    rates = counts.select("_g", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    rates = cut_lineage(rates.select("_g", "parts", poisson_steps(F.col("rate") / F.col("parts")).alias("steps")), "rates")

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def draw(part):
        u = uniform(F.lit(str(seed)), name, part.cast("string"))
        return F.size(F.filter("steps", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda acc, p: acc + draw(p))
    rows = prompts.join(rates, prompts[group].eqNullSafe(rates["_g"])).withColumn("_n", copies).where("_n > 0")
    kept = [c for c in prompts.columns if c not in ("copy", "shuffle_key")]
    rows = rows.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    mixed = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.lit("copy"), F.col("copy").cast("string"))))
    return mixed.orderBy("shuffle_key", key, "copy")
