"""Secrets in log messages: three fixed rules, and character Markov models for whatever else looks random.

Everything here is DataFrame expressions; the models are trained by two aggregations over labelled strings.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the rules
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_SPANS = "array<struct<s:int,k:int,e:int>>"
_N = len(SYMBOLS)


def _empty() -> Column:
    return F.array().cast(_SPANS)


def found(text: Column, rule: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches in code points, end exclusive,
    that ``keep`` accepts (a function of the group's text; all without it)."""
    n = F.regexp_count(text, F.lit(rule))
    steps = F.arrays_zip(
        F.slice(F.split(text, rule, -1), 1, n).alias("gap"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule), F.lit(group)).alias("part"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        more = F.concat(acc["out"], F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"))))
        out = more if keep is None else F.when(keep(x["part"]), more).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), _empty().alias("out"))
    return F.when(text.rlike(rule), F.aggregate(steps, first, step, lambda acc: acc["out"])).otherwise(_empty())


def _pairs(value: Column) -> Column:
    """Numbers of the character pairs of a string, -1 for a pair with another character."""
    n = F.length(value)
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    pairs = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: F.when((a < 0) | (b < 0), F.lit(-1)).otherwise(a * _N + b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<int>"))


def train_string_models(samples: DataFrame, value: str = "value", random: str = "random", smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratio (random against ordinary) of each character pair, in thousandths.

    ``samples`` holds strings labelled as random (true) or ordinary identifiers (false). Each model is a
    first-order Markov chain over the 67 symbols, smoothed towards how often a symbol follows at all; what
    comes back is one number for each of the 67 x 67 pairs, whatever the number of samples. Null strings and labels are passed over;
    without samples every ratio is 0.
    """
    pairs = samples.where(F.col(value).isNotNull() & F.col(random).isNotNull()).select(
        F.col(random).alias("r"), F.explode(_pairs(F.col(value))).alias("p")).where("p >= 0")
    counts = {(x["r"], x["p"]): x["n"] for x in pairs.groupBy("r", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = (True, False)
    total = {(r, a): sum(counts.get((r, a * _N + b), 0) for b in range(_N)) for r in kinds for a in range(_N)}
    after = {(r, b): sum(counts.get((r, a * _N + b), 0) for a in range(_N)) for r in kinds for b in range(_N)}
    every = {r: sum(total[r, a] for a in range(_N)) for r in kinds}

    def log(r, p):
        a, b = divmod(p, _N)
        alone = (after[r, b] + smoothing) / (every[r] + smoothing * _N)
        return math.log((counts.get((r, p), 0) + smoothing * _N * alone) / (total[r, a] + smoothing * _N))

    return [round(1000 * (log(True, p) - log(False, p))) for p in range(_N * _N)]


def labelled_samples(logs: DataFrame, key: str = "line", message: str = "message", messages: int = 20_000, least: int = 6) -> DataFrame:
    """Labelled strings (``value``, ``random``) out of the messages themselves.

    At most ``messages`` messages are read, those with the smallest hashes of their keys. What the fixed
    rules find is labelled random; words of messages without a find are ordinary.
    """
    h = F.xxhash64(F.col(key))
    edge = logs.select(h.alias("h")).orderBy("h").limit(messages).agg(F.max("h").alias("h")).first()["h"]
    text = F.coalesce(F.col(message), F.lit(""))
    rows = logs.where(F.lit(edge is not None) & (h <= F.lit(edge or 0))).select(text.alias("t")).select(
        "t", F.concat(*[F.regexp_extract_all("t", F.lit(r), F.lit(g)) for r, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))]).alias("hits"))
    bad = rows.select(F.explode("hits").alias("value"), F.lit(True).alias("random"))
    good = rows.where(F.size("hits") == 0).select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("value"), F.lit(False).alias("random"))
    return bad.unionByName(good).where(F.length("value") >= least)


def log_secrets(logs: DataFrame, ratios: list[int], key: str = "line", message: str = "message", least: int = 16, threshold: float = 12.0) -> DataFrame:
    """Secrets in the whole message of each stage log line (a run's log may hold keys of its services).

    Returns ``key``, ``n_assign``, ``n_access``, ``n_hex`` and ``found``, the spans (``s`` start, ``k`` place in
    ``KINDS``, ``e`` end, in code points) in the order of start and kind. Fixed rules give the first three
    kinds. A run of at least ``least`` key characters that touches none of those is a ``markov`` span if the
    sum of its pair ratios (``train_string_models``) reaches ``threshold`` nats.

    Null messages count as empty. Repeated rows and null keys give a row each. Spans are folded
    inside the row, so the work grows with the text; other columns of ``logs`` are not read.
    """
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")

    def odd(word):
        return F.aggregate(_pairs(word), F.lit(0), lambda acc, p: acc + F.when(p < 0, F.lit(0)).otherwise(F.get(table, p))) >= int(threshold * 1000)

    t = F.col("t")
    rows = logs.select(F.col(key).alias("id"), F.coalesce(F.col(message), F.lit("")).alias("t"))
    rows = rows.select(
        "id", found(t, ASSIGN, 0, lambda v: F.length(v) >= 6, 2).alias("a"), found(t, ACCESS, 1).alias("b"), found(t, HEX, 2).alias("c"),
        found(t, r"[A-Za-z0-9+/_=-]{%d,}" % least, 3, odd).alias("m"))
    rows = rows.select("id", *[F.size(x).cast("bigint").alias(n) for x, n in zip("abc", ("n_assign", "n_access", "n_hex"))], F.concat("a", "b", "c").alias("base"), "m")
    free = F.filter("m", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return rows.select(F.col("id").alias(key), "n_assign", "n_access", "n_hex", F.array_sort(F.concat("base", free)).alias("found"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
