"""Rule checks: rows in, error rows or error columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes, fixed
from ..functions.spans import has_span
from ..functions.text import count, has_cjk, is_blank, let, strip, tag_set, tokens
from .joins import verbatim_missing
from .scan import numbered
from .sections import heading_errors, section_body
from .sets import exact_cover, missing_tags
from .shape import rule_errors
from .windows import shot_errors

_SHAPES = ["vertical", "horizontal", "square", "full"]  # fixed values


def _rows_of(df: DataFrame, keys: list[str], errors: Column) -> DataFrame:
    return df.select(*keys, F.explode(errors).alias("rule"))


def check_layout(pages: DataFrame, panels: DataFrame, page: str, no: str, x: str, y: str, w: str, h: str, shape: str, summary: str) -> DataFrame:
    """Error rows (page, panel number or null, rule) of page layouts."""
    c = F.col
    box = [c(v) for v in (x, y, w, h)]
    lacking = box[0].isNull() | box[1].isNull() | box[2].isNull() | box[3].isNull()
    rules = rule_errors({
        "no": c(no).isNull() | (c(no) < 1),
        "box parts": lacking,
        "box origin": ~lacking & ~(box[0].between(0, 1) & box[1].between(0, 1)),
        "box size": ~lacking & box[0].between(0, 1) & box[1].between(0, 1) & ((box[2] <= 0) | (box[3] <= 0)),
        "shape": ~F.coalesce(c(shape).isin(_SHAPES), F.lit(False)),
    })
    per_panel = _rows_of(panels, [page, no], rules)
    blank = pages.where(is_blank(c(summary))).select(page, F.lit(None).cast("int").alias(no), F.lit("summary").alias("rule"))
    empty = pages.join(panels, page, "left_anti").select(page, F.lit(None).cast("int").alias(no), F.lit("no panels").alias("rule"))
    twice = panels.where(c(no) >= 1).groupBy(page, no).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = twice.select(page, c(no).cast("int").alias(no), F.lit("no repeated").alias("rule"))
    return per_panel.select(page, c(no).cast("int").alias(no), "rule").unionByName(blank).unionByName(empty).unionByName(twice)


def detail_errors(json: Column) -> Column:
    """Errors of a panel detail given as JSON text: missing fields, else wrong types."""
    lists, texts = ["characters", "dialogue", "onomatopoeia"], ["action", "setting", "camera", "clothing_notes"]
    v = F.try_parse_json(json)

    def kind(field):
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")), F.lit("ABSENT"))

    def bad_items(field, name):
        items = F.try_variant_get(v, f"$.{field}", "array<variant>")
        return F.exists(items, lambda i: F.coalesce(F.schema_of_variant(F.try_variant_get(i, f"$.{name}", "variant")), F.lit("")) != "STRING")

    absent = rule_errors({f"missing {k}": kind(k) == "ABSENT" for k in lists + texts})
    wrong = rule_errors({
        **{f"{k} not a list": ~kind(k).startswith("ARRAY") for k in lists},
        **{f"{k} not a text": kind(k) != "STRING" for k in texts},
        "characters item": kind("characters").startswith("ARRAY") & bad_items("characters", "name"),
        "dialogue item": kind("dialogue").startswith("ARRAY") & bad_items("dialogue", "text"),
    })
    not_object = ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")
    return F.when(not_object, F.array(F.lit("not an object"))).when(F.size(absent) > 0, absent).otherwise(wrong)


def check_entities(
    entities: DataFrame, states: DataFrame, key: str, *, name: str = "name", aliases: str = "aliases", gender: str = "gender",
    appearance: str = "appearance", tags: str = "tags", anchor_name: str = "anchor_name", anchor_origin: str = "anchor_origin",
    pages: str = "pages", state_text: str = "state_text",
) -> DataFrame:
    """Error rows (entity, rule) of the settings table; ``states`` holds the interval texts."""
    c = F.col
    first = F.lower(F.coalesce(F.try_element_at(tokens(c(tags)), F.lit(1)), F.lit("")))
    rules = rule_errors({
        "name": is_blank(c(name)),
        "aliases": c(aliases).isNull(),
        "gender": ~F.coalesce(F.lower(strip(c(gender))).isin("female", "male"), F.lit(False)),
        "appearance": F.length(F.coalesce(strip(c(appearance)), F.lit(""))) < 5,
        "tags": is_blank(c(tags)),
        "first tag": ~is_blank(c(tags)) & ~first.isin(fixed.FIRST_TAGS),
        "anchor name": is_blank(c(anchor_name)),
        "anchor origin": is_blank(c(anchor_origin)),
    })
    own = _rows_of(entities, [key], rules)
    clean = entities.where(~is_blank(c(name))).withColumn("_name", strip(c(name)))
    twice = clean.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_name")
    repeated = clean.join(twice, "_name", "left_semi").select(key, F.lit("name repeated").alias("rule"))
    stateless = entities.join(states, key, "left_anti").select(key, F.lit("no states").alias("rule"))
    bad_state = _rows_of(states, [key], rule_errors({
        "state pages": ~has_span(c(pages)), "state text": is_blank(c(state_text))})).distinct()
    return own.unionByName(repeated).unionByName(stateless).unionByName(bad_state)


def check_issue_rows(issues: DataFrame, cols: list[str] = ("file", "problem", "fix")) -> tuple[DataFrame, DataFrame]:
    """Trimmed good issue rows, and the rejected ones with the blank columns named."""
    d = issues.withColumn("errors", rule_errors({f"{c} blank": is_blank(F.col(c)) for c in cols}))
    good = d.where(F.size("errors") == 0).drop("errors").withColumns({c: strip(F.col(c)) for c in cols})
    return good, d.where(F.size("errors") > 0)


def check_placements(placements: DataFrame, expected: DataFrame, panel: str, n_lines: str, x: str, y: str, w: str, h: str) -> DataFrame:
    """Per panel: are all placements usable and as many as lines; one bad one rejects the set."""
    c, top = F.col, fixed.PLACEMENT_SLACK
    good = (c(x).between(0, 1) & c(y).between(0, 1) & (c(w) > 0) & (c(w) <= 1) & (c(h) > 0) & (c(h) <= 1)
            & (c(x) + c(w) <= top) & (c(y) + c(h) <= top))
    per = placements.groupBy(panel).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"))
    d = expected.join(per, panel, "left")
    ok = F.coalesce(c("_good") & (c("_n") == c(n_lines)), F.lit(False))
    return d.select(panel, n_lines, F.when(ok, "model").otherwise("fallback").alias("layout"))


def tail_point(tail: Column) -> Column:
    """Bubble tail ``[x, y]``; anything else gives null."""
    return F.when((F.size(tail) >= 2) & tail[0].isNotNull() & tail[1].isNotNull(), F.slice(tail, 1, 2))


def segment_errors(seg: Column, place: Column, duration: Column, beat: Column, max_seconds: float = fixed.MAX_SEGMENT_SECONDS) -> Column:
    return rule_errors({
        "seg number": F.coalesce(seg != place, F.lit(True)),
        "duration": ~F.coalesce(duration.between(1.0, max_seconds), F.lit(False)),
        "beat": is_blank(beat),
    })


def check_segments(
    segments: DataFrame, used: DataFrame, units: DataFrame, keys: list[str], *, seg: str, place: list[str], duration: str, beat: str,
    unit: str, order: list[str], unit_order: list[str], max_seconds: float = fixed.MAX_SEGMENT_SECONDS,
) -> DataFrame:
    """Error rows (keys, item, rule): segment rules and exact cover of the units."""
    d = numbered(segments, keys, place, "_place")
    own = d.select(*keys, F.col(seg).cast("string").alias("item"), F.explode(
        segment_errors(F.col(seg), F.col("_place"), F.col(duration), F.col(beat), max_seconds)).alias("rule"))
    cover = exact_cover(used, units, keys, unit, order, unit_order)
    return own.unionByName(cover.select(*keys, F.col(unit).cast("string").alias("item"), F.col("problem").alias("rule")))


def second_lines(body: Column) -> Column:
    """``X-Ys`` lines of a shot design as ``struct<a,b>`` in text order."""
    pattern = r"^\s*(?:[-*+]\s*)?(?:\*\*)?(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)s"
    hits = F.filter(F.split(body, "\n"), lambda s: s.rlike(pattern))
    return F.transform(hits, lambda s: F.struct(
        F.regexp_extract(s, pattern, 1).cast("double").alias("a"), F.regexp_extract(s, pattern, 2).cast("double").alias("b")))


def segment_script_errors(text: Column, duration: Column, dialogue: Column, design_title: str = "逐秒镜头设计") -> Column:
    """Headings present, seconds gapless from 0 to the whole duration, dialogue verbatim. Nulls count as blank and as no dialogue."""
    text, dialogue = F.coalesce(text, F.lit("")), F.coalesce(dialogue, F.array().cast("array<string>"))

    def second_errors(spans):
        n = F.size(spans)
        broken = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i < n) & (
            F.try_element_at(spans, i)["b"] != F.try_element_at(spans, i + 1)["a"]))
        return rule_errors({
            "no seconds": n == 0,
            "not from 0": (n > 0) & (F.try_element_at(spans, F.lit(1))["a"] != 0),
            "gap": (n > 0) & broken,
            "too short": (n > 0) & (F.try_element_at(spans, F.lit(-1))["b"] < F.floor(duration)),
        })

    heads = F.filter(F.array(*[F.lit(h) for h in fixed.SEGMENT_HEADINGS]), lambda h: ~text.contains(h))
    lost = F.filter(dialogue, lambda s: ~text.contains(s))
    return F.concat(
        F.transform(heads, lambda h: F.concat(F.lit("missing "), h)),
        let(second_lines(section_body(text, design_title)), second_errors),
        F.transform(lost, lambda s: F.concat(F.lit("not verbatim: "), s)))


def prompt_errors(prompt: Column, mode: Column, duration: Column, dialogue: Column, names: Column) -> Column:
    """Broken rules of a video prompt. All work stays inside the row.

    A null prompt counts as blank, a null mode is a broken rule, null lists of lines and names are empty.
    """
    prompt, none = F.coalesce(prompt, F.lit("")), F.array().cast("array<string>")
    dialogue, names = F.coalesce(dialogue, none), F.coalesce(names, none)
    lines = F.split(prompt, "\n")
    line1, line2 = F.try_element_at(lines, F.lit(1)), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    opening = F.try_element_at(F.filter(lines, lambda s: strip(s) != ""), F.lit(1))
    pictured = F.coalesce(mode == "i2va", F.lit(False))
    n_open, n_cn, n_close = count(prompt, "<d>"), count(prompt, "<d>[Chinese]"), count(prompt, "</d>")
    before = rule_errors({
        "mode missing": mode.isNull(),
        "first line": pictured & (F.regexp_replace(line1, r"\s+$", "") != fixed.I2VA_FIRST_LINE),
        "second line not blank": pictured & (strip(line2) != ""),
        "first line not allowed": ~pictured & prompt.contains(fixed.I2VA_FIRST_LINE),
        "start field": ~pictured & ~F.coalesce(opening, F.lit("")).startswith(fixed.PROMPT_FIELDS[0]),
    })
    fields = heading_errors(prompt, fixed.PROMPT_FIELDS, advance_on_error=True)
    after = shot_errors(prompt, duration), rule_errors({
        "tags unbalanced": ~((n_open == n_cn) & (n_cn == n_close)),
        "dialogue not verbatim": F.exists(dialogue, lambda s: ~prompt.contains(s)),
        "lock phrase": ~prompt.contains(fixed.LOCK_PHRASE),
        "name missing": F.exists(names, lambda s: ~prompt.contains(s)),
    })
    return F.concat(before, fields, *after)


def check_prompts_set(prompts: DataFrame, cast: DataFrame, entities: DataFrame, panel: str) -> DataFrame:
    """Error rows (panel, rule, detail) of a prompt table; ``warn`` rows are hints only.

    ``prompts``: panel, positive, negative, width, height, size_bucket, crop_w, crop_h.
    ``cast``: panel, name, anchor. ``entities``: name, tags, state_tags (current settings).
    """
    c = F.col
    here = boxes.shape_of(c("crop_w"), c("crop_h"))
    want_w, want_h = boxes.bucket_side(here, 0), boxes.bucket_side(here, 1)
    cjk = F.filter(tokens(c("positive")), lambda s: has_cjk(s))
    own = prompts.select(panel, F.explode(F.filter(F.array(
        F.when(F.size(tag_set(c("positive"))) == 0, F.struct(F.lit("empty").alias("rule"), F.lit("").alias("detail"))),
        F.when(~here.eqNullSafe(c("size_bucket")) | ~want_w.eqNullSafe(c("width")) | ~want_h.eqNullSafe(c("height")) | here.isNull(),
               F.struct(F.lit("bucket").alias("rule"), F.coalesce(here, F.lit("no crop size")).alias("detail"))),
        F.when(F.size(cjk) > 0, F.struct(F.lit("cjk").alias("rule"), F.array_join(cjk, "; ").alias("detail"))),
        F.when(has_cjk(c("negative")), F.struct(F.lit("warn negative cjk").alias("rule"), F.lit("").alias("detail"))),
    ), lambda e: e.isNotNull())).alias("_e")).select(panel, "_e.*")
    known = cast.join(entities, "name", "left")
    unknown = cast.join(entities, "name", "left_anti").select(panel, F.lit("unknown entity").alias("rule"), c("name").alias("detail"))
    need = F.concat_ws(",", "tags", "state_tags")
    lost = known.where(c("tags").isNotNull()).join(prompts.select(panel, "positive"), panel).select(
        panel, "name", F.explode(missing_tags(need, c("positive"))).alias("_t"))
    lost = lost.select(panel, F.lit("tag missing").alias("rule"), F.concat_ws(":", "name", "_t").alias("detail"))
    anchor = F.coalesce(c("anchor"), F.lit(""))
    torn = cast.groupBy("name").agg(F.min(anchor).alias("_a"), F.max(anchor).alias("_b")).where("_a <> _b").select("name")
    conflict = cast.join(torn, "name", "left_semi").select(panel, F.lit("anchor differs").alias("rule"), c("name").alias("detail")).distinct()
    return own.unionByName(unknown).unionByName(lost).unionByName(conflict)


def check_static(expected: DataFrame, docs: DataFrame, required: DataFrame, key: str, text: str, wanted: str, headings: list[str]) -> DataFrame:
    """Issue rows (key, problem): absent document, absent heading, text not verbatim."""
    absent = expected.join(docs, key, "left_anti").select(key, F.lit("document missing").alias("problem"))
    here = docs.join(expected, key, "left_semi")
    heads = F.filter(F.array(*[F.lit(h) for h in headings]), lambda h: ~F.coalesce(F.col(text).contains(h), F.lit(False)))
    headless = here.select(key, F.explode(heads).alias("_h")).select(key, F.concat(F.lit("missing "), "_h").alias("problem"))
    # an absent document is one issue, not one per text as well
    lost = verbatim_missing(required.join(here, key, "left_semi"), here, [key], wanted, text).select(key, F.concat(F.lit("not verbatim: "), strip(F.col(wanted))).alias("problem"))
    return absent.unionByName(headless).unionByName(lost)


def check_duration(df: DataFrame, actual: str, expected: str, tolerance: float = fixed.DURATION_TOLERANCE) -> DataFrame:
    return df.withColumn("off", F.col(actual) - F.col(expected)).withColumn("warn", F.abs("off") > tolerance)
