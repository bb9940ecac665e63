"""Deterministic repair of video prompts, and the check-repair loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.clock import shot_clock
from ..functions.text import count, strip
from ..session import cut_lineage

_DESC, _SOUND, _MUSIC = fixed.PROMPT_FIELDS
_rstrip = lambda c: F.regexp_replace(c, r"\s+$", "")


def _from(c: Column, at: Column) -> Column:
    return F.substring(c, at, F.length(c))


def _before(c: Column, mark: str, insert: Column) -> Column:
    """Put text at the end of what stands before the mark, or at the very end."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.concat(_rstrip(F.substring(c, F.lit(1), at - 1)), insert, F.lit("\n\n"), _from(c, at))).otherwise(F.concat(c, insert))


def _swap_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), _from(c, at + len(old)))).otherwise(c)


def repair_video_prompt(df: DataFrame, prompt: str, mode: str, duration: str, dialogue: str, names: str) -> DataFrame:
    """Prefix, three fields, balanced tags, dialogue, lock phrase, names and evenly spaced shots."""
    p = F.col(prompt)
    lock = f"({fixed.LOCK_PHRASE})"

    def step(d, value):
        return d.withColumn(prompt, value)

    d = step(df, strip(F.replace(strip(p), F.lit(fixed.I2VA_FIRST_LINE), F.lit(""))))
    at = F.instr(p, _DESC)
    d = step(d, F.when(at > 0, _from(p, at)).otherwise(F.concat(F.lit(_DESC + " "), p)))
    music = F.instr(p, _MUSIC)
    with_sound = F.when(music > 0, F.concat(_rstrip(F.substring(p, F.lit(1), music - 1)), F.lit("\n\n" + fixed.DEFAULT_SOUNDSCAPE + "\n\n"), _from(p, music))).otherwise(
        F.concat(p, F.lit("\n\n" + fixed.DEFAULT_SOUNDSCAPE)))
    d = step(d, F.when(F.instr(p, _SOUND) > 0, p).otherwise(with_sound))
    d = step(d, F.when(F.instr(p, _MUSIC) > 0, p).otherwise(F.concat(p, F.lit("\n\n" + fixed.DEFAULT_MUSIC))))
    d = step(d, F.regexp_replace(p, r"<d>(?!\[Chinese\])", "<d>[Chinese]"))
    short = count(p, "<d>[Chinese]") - count(p, "</d>")
    d = step(d, F.when(short > 0, _before(p, _SOUND, F.repeat(F.lit(" </d>"), short))).otherwise(p))
    lost = F.filter(F.coalesce(F.col(dialogue), F.array().cast("array<string>")), lambda s: ~F.col(prompt).contains(s))
    said = F.concat(F.lit(" "), F.array_join(F.transform(lost, lambda s: F.concat(F.lit("An off-screen voiceover says: <d>[Chinese] "), s, F.lit(" </d>."))), " "))
    d = step(d, F.when(F.size(lost) > 0, _before(p, _SOUND, said)).otherwise(p))
    sound = F.instr(p, _SOUND)
    desc = F.when(sound > 0, F.substring(p, F.lit(1), sound - 1)).otherwise(p)
    locked = F.when(desc.contains("[Shot 1]"), _swap_first(p, "[Shot 1]", "[Shot 1] " + lock)).otherwise(_swap_first(p, _DESC, f"{_DESC} [Shot 1] {lock}"))
    d = step(d, F.when(desc.contains(fixed.LOCK_PHRASE), p).otherwise(locked))
    d = step(d, F.aggregate(
        F.coalesce(F.col(names), F.array().cast("array<string>")), p,
        lambda acc, n: F.when(acc.contains(n), acc).otherwise(
            _before(acc, _SOUND, F.concat(F.lit(" (Featuring character "), n, F.lit(f"; {fixed.LOCK_PHRASE}.)"))))))
    body = F.regexp_replace(desc, r"\[Shot 1\]\s+At\s+\d{2}:\d{2}\.\d{3},?", "[Shot 1]")
    d = d.withColumn("_rest", F.when(sound > 0, _from(p, sound)).otherwise(F.lit(""))).withColumn("_body", body)
    k = F.size(F.regexp_extract_all("_body", F.lit(r"\[Shot (\d+)\]"), 1))

    def spaced(acc, i):
        shot = i.cast("string")
        old = F.concat(F.lit(r"\[Shot "), shot, F.lit(r"\](?:\s+At\s+\d{2}:\d{2}\.\d{3},?)?"))
        new = F.concat(F.lit("[Shot "), shot, F.lit("] At "), shot_clock((i - 1) * F.col(duration) / k), F.lit(","))
        return F.regexp_replace(acc, old, new)

    d = d.withColumn("_body", F.when(k >= 2, F.aggregate(F.sequence(F.lit(2), F.greatest(k, F.lit(2))), F.col("_body"), spaced)).otherwise(F.col("_body")))
    d = step(d, strip(F.when(F.col("_rest") != "", F.concat(_rstrip(F.col("_body")), F.lit("\n\n"), "_rest")).otherwise(F.col("_body"))))
    d = step(d, F.when(F.col(mode) == "i2va", F.concat(F.lit(fixed.I2VA_FIRST_LINE + "\n\n"), p)).otherwise(p))
    return d.drop("_rest", "_body")


def repair_loop(
    df: DataFrame, check: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], max_rounds: int = 2
) -> DataFrame:
    """Check, repair only what fails, check again, at most ``max_rounds`` times.

    ``check`` adds an array column ``errors``. Adds ``initial`` (errors at first), ``rounds`` and
    ``final``. The loop is on the driver; each round stores its rows, as it is read twice.
    """
    cols = df.columns
    d = cut_lineage(check(df).select(*cols, F.size("errors").alias("initial"), F.lit(0).alias("rounds"), F.size("errors").alias("final")))
    done, open_rows = d.where("final = 0"), d.where("final > 0")
    for _ in range(max_rounds):
        if open_rows.isEmpty():
            break
        fixed_rows = check(repair(open_rows)).select(*cols, "initial", (F.col("rounds") + 1).alias("rounds"), F.size("errors").alias("final"))
        fixed_rows = cut_lineage(fixed_rows)
        done, open_rows = done.unionByName(fixed_rows.where("final = 0")), fixed_rows.where("final > 0")
    return done.unionByName(open_rows)
