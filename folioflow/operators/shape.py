"""Projections, filters and predicates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes, fixed, seeds
from ..functions.text import in_parentheses, is_blank, strip, synonym  # noqa: F401

_LINE = "struct<kind:string,text:string,speaker:string>"


def explode_children(df: DataFrame, parent: str, children: str, key_format: str = "p%03d_%02d") -> DataFrame:
    """One row per child struct (field ``no``), with the composite text key."""
    d = df.select("*", F.explode(children).alias("_c")).select(
        *[c for c in df.columns if c != children], "_c.*"
    )
    return d.withColumn("key", F.format_string(key_format, F.col(parent), F.col("no")))


def compact(df: DataFrame, children: str, keep: list[str]) -> DataFrame:
    """Slim an array of structs to the fields a later step needs."""
    return df.withColumn(children, F.transform(children, lambda c: F.struct(*[c[k].alias(k) for k in keep])))


def coerce_detail(
    df: DataFrame, people: str = "characters", dialogue: str = "dialogue",
    sounds: str = "onomatopoeia", texts: list[str] = ("action", "setting", "camera", "clothing_notes"),
) -> DataFrame:
    """Canonical types of a panel detail: no nulls, ``?`` for unnamed, sounds as an array without blanks."""
    def text(c):
        return F.coalesce(c, F.lit(""))

    def named(c):
        return F.when(text(c) == "", "?").otherwise(c)

    kind = df.schema[sounds].dataType.typeName()
    raw = F.col(sounds) if kind == "array" else F.when(~is_blank(F.col(sounds)), F.array(sounds))
    out = {
        people: F.coalesce(F.transform(people, lambda c: F.struct(
            named(c["name"]).alias("name"), text(c["appearance"]).alias("appearance"))), F.array()),
        dialogue: F.coalesce(F.transform(dialogue, lambda c: F.struct(
            named(c["speaker"]).alias("speaker"), text(c["text"]).alias("text"))), F.array()),
        sounds: F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda s: text(s) != ""),
    }
    return df.withColumns({**out, **{c: text(F.col(c)) for c in texts if c in df.columns}})


def flatten_lines(df: DataFrame, keys: list[str], dialogue: str, sounds: str) -> DataFrame:
    """Dialogue, then sounds, one row each with a dense ``idx`` per parent; blanks are skipped."""
    spoken = F.transform(dialogue, lambda d: F.struct(
        F.when(F.coalesce(d["speaker"], F.lit("")).contains(fixed.NARRATION_MARK), "narration").otherwise("bubble").alias("kind"),
        strip(F.coalesce(d["text"], F.lit(""))).alias("text"),
        strip(F.coalesce(d["speaker"], F.lit(""))).alias("speaker")).cast(_LINE))
    heard = F.transform(sounds, lambda s: F.struct(
        F.lit("sfx").alias("kind"), strip(F.coalesce(s, F.lit(""))).alias("text"), F.lit("").alias("speaker")).cast(_LINE))
    lines = F.filter(F.concat(spoken, heard), lambda x: x["text"] != "")
    return df.select(*keys, F.posexplode(lines).alias("idx", "_l")).select(*keys, "idx", "_l.*")


def clamp_boxes(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
    side = fixed.BOX_MIN_SIDE
    return df.withColumns({
        x: boxes.clamp(F.col(x), 0.0, 1.0), y: boxes.clamp(F.col(y), 0.0, 1.0),
        w: boxes.clamp(F.col(w), side, 1.0), h: boxes.clamp(F.col(h), side, 1.0),
    })


def crop_rects(
    df: DataFrame, x: str, y: str, w: str, h: str, page_w: str, page_h: str, shape: str,
    margin: float = fixed.BOX_MARGIN,
) -> DataFrame:
    """Pixel rectangle of a box grown by the margin, at least one pixel each way; ``full`` = whole page."""
    x0, y0 = F.greatest(F.lit(0.0), F.col(x) - margin), F.greatest(F.lit(0.0), F.col(y) - margin)
    x1 = F.least(F.lit(1.0), x0 + F.col(w) + 2 * margin)
    y1 = F.least(F.lit(1.0), y0 + F.col(h) + 2 * margin)
    pw, ph = F.col(page_w).cast("int"), F.col(page_h).cast("int")
    left, top = boxes.pixel(x0 * pw), boxes.pixel(y0 * ph)
    right = F.greatest(left + 1, F.least(pw, boxes.pixel(x1 * pw)))
    bottom = F.greatest(top + 1, F.least(ph, boxes.pixel(y1 * ph)))
    full = F.col(shape) == "full"
    return df.withColumns({
        "left": F.when(full, F.lit(0)).otherwise(left), "top": F.when(full, F.lit(0)).otherwise(top),
        "right": F.when(full, pw).otherwise(right), "bottom": F.when(full, ph).otherwise(bottom),
    })


def layout_rects(panels: DataFrame, pages: DataFrame, on: list[str], x: str, y: str, w: str, h: str, page_w: str, page_h: str) -> DataFrame:
    """Place normalised boxes on the pixels of their page."""
    return panels.join(pages, on).withColumns({
        "left": boxes.pixel(F.col(x) * F.col(page_w)), "top": boxes.pixel(F.col(y) * F.col(page_h)),
        "width": boxes.pixel(F.col(w) * F.col(page_w)), "height": boxes.pixel(F.col(h) * F.col(page_h)),
    })


def aspect_bucket(df: DataFrame, w: str, h: str) -> DataFrame:
    b = boxes.shape_of(F.col(w), F.col(h))
    return df.withColumn("bucket", b).withColumns({
        "target_w": boxes.bucket_side(F.col("bucket"), 0), "target_h": boxes.bucket_side(F.col("bucket"), 1),
    })


def effective_param(opts: Column, run: Column, default: str, allowed: list[str] | None = None) -> Column:
    """Call option, else run parameter, else default; a value outside ``allowed`` gives the default."""
    value = F.coalesce(opts, run, F.lit(default))
    return value if allowed is None else F.when(value.isin(allowed), value).otherwise(F.lit(default))


def effective_params(default: dict[str, str], run: Column, opts: Column) -> Column:
    """Whole parameter maps, later ones win per key."""
    base = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    keys = F.array_distinct(F.concat(F.map_keys(base), F.map_keys(run), F.map_keys(opts)))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("key"), F.coalesce(F.try_element_at(opts, k), F.try_element_at(run, k), F.try_element_at(base, k)).alias("value"))))


def render_jobs(
    segments: DataFrame, run_id: str, *, seg: str = "seg", duration: str = "duration", mode: str = "mode",
    first_frame: str = "first_frame", max_seconds: float = fixed.MAX_SEGMENT_SECONDS,
    megapixels: float = 0.4, aspect: str = "16:9 (Widescreen)",
) -> DataFrame:
    """One parameter row per segment; the dry run is this frame itself."""
    key = F.format_string("seg_%02d", F.col(seg))
    with_frame = F.col(mode) == "i2va"
    return segments.select(
        key.alias("seg_key"), F.col(mode).alias("mode"),
        F.least(F.col(duration), F.lit(max_seconds)).alias("duration"),
        F.when(with_frame, F.regexp_extract(first_frame, r"([^/]*)$", 1)).alias("image"),
        F.when(~with_frame, F.lit(aspect)).alias("aspect_ratio"),
        F.lit(megapixels).alias("megapixels"),
        seeds.seed64(F.concat(F.lit(run_id + ":"), key)).alias("noise_seed"),
        F.concat(F.lit(run_id + "/"), key).alias("filename_prefix"),
    )


def image_jobs(prompts: DataFrame, run_id: str, *, panel: str, width: str, height: str, seed: str, hd: bool = False) -> DataFrame:
    """Image parameter rows; the high tier scales the bucket."""
    k = fixed.HD_FACTOR if hd else 1.0
    return prompts.select(
        F.col(panel).alias("panel"), boxes.pixel(F.col(width) * k).alias("width"),
        boxes.pixel(F.col(height) * k).alias("height"), F.col(seed).alias("seed"),
        F.concat(F.lit(run_id + "/"), F.col(panel).cast("string")).alias("filename_prefix"),
    )


def select_units(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is wanted, and the wanted keys that do not exist."""
    w = wanted.select(key).distinct()
    return df.join(w, key, "left_semi"), w.join(df, key, "left_anti")


def unify_aliases(
    df: DataFrame, col: str, spec: dict[str, list[str]], bare: tuple[str, str] | None = None, error: str | None = None, depth: int = 4,
) -> DataFrame:
    """Standard columns from JSON whose keys vary and which may lie inside lists and wrapper objects.

    An object that has one of the names (letter case ignored) is a record; other objects and all lists are walked into, level
    by level in the order of the text, ``depth`` objects deep. A column takes its value from the first record that has it, by the
    standard key itself, then by the aliases in order. With ``bare = (column, key)``, a list whose elements are all objects with that
    key, or one such object, is that column if there is no record. What is missing is an empty text.

    ``error`` names a column for what went wrong: ``not JSON`` or ``no record``, else null; a null text is ``not JSON``.
    """
    one, items = "map<string,string>", "array<string>"
    names = {x for std, aliases in spec.items() for x in (std.lower(), *aliases)}
    begins = lambda t, *marks: F.substring(F.ltrim(t), 1, 1).isin(*marks)
    inner = lambda texts: F.filter(texts, lambda t: begins(t, "{", "["))
    nothing = F.array().cast(items)

    def unlisted(texts):
        """Elements in place of lists, and of lists inside these."""
        for _ in range(2):
            texts = F.flatten(F.transform(texts, lambda t: F.when(begins(t, "["), F.coalesce(inner(F.from_json(t, items)), nothing)).otherwise(F.array(t))))
        return F.filter(texts, lambda t: begins(t, "{"))

    def named(entries):
        return F.exists(F.map_keys(entries), lambda k: F.lower(k).isin(*names))

    d = df.withColumn("_at", unlisted(F.when(begins(F.col(col), "{", "["), F.array(col)).otherwise(nothing))).withColumn("_top", F.col("_at"))
    d = d.withColumn("_r", F.array().cast(f"array<{one}>"))
    for level in range(depth):
        read = F.filter(F.transform("_at", lambda t: F.from_json(t, one)), lambda m: m.isNotNull())
        d = d.withColumn("_m", read).withColumn("_r", F.concat("_r", F.filter("_m", named)))
        if level < depth - 1:
            d = d.withColumn("_at", unlisted(F.flatten(F.transform(F.filter("_m", lambda m: ~named(m)), lambda m: inner(F.map_values(m))))))

    def value(alias, exact):
        held = F.filter("_r", lambda m: F.exists(F.map_keys(m), lambda k: (k if exact else F.lower(k)) == alias))
        hit = F.filter(F.map_entries(F.try_element_at(held, F.lit(1))), lambda e: (e["key"] if exact else F.lower(e["key"])) == alias)
        return F.try_element_at(hit, F.lit(1))["value"]

    out = {std: F.coalesce(*[value(a, e) for a, e in [(std, True), *[(x, False) for x in aliases]]]) for std, aliases in spec.items()}
    found = F.size("_r") > 0
    if bare:
        column, key = bare
        every = F.forall("_top", lambda t: F.coalesce(F.map_contains_key(F.from_json(t, one), F.lit(key)), F.lit(False))) & (F.size("_top") > 0)
        text = F.concat(F.lit("["), F.array_join("_top", ","), F.lit("]"))
        out[column] = F.when(~found & every, text).otherwise(out[column])
        found = found | every
    if error:
        out[error] = F.when(F.col(col).isNull() | F.try_parse_json(col).isNull(), "not JSON").when(~found, "no record")
    out = {c: v if c == error else F.coalesce(v, F.lit("")) for c, v in out.items()}
    return d.withColumns(out).drop("_at", "_top", "_r", "_m")


def normalise_category(
    df: DataFrame, col: str, words: dict[str, list[str]], clues: list[tuple[Column, str]], default: str, out: str
) -> DataFrame:
    """Canonical category of a synonym; else the first clue that holds; else the default."""
    value = synonym(F.col(col), words)
    for cond, name in clues:
        value = F.coalesce(value, F.when(cond, F.lit(name)))
    return df.withColumn(out, F.coalesce(value, F.lit(default)))


def split_qualified(df: DataFrame, col: str, name: str, origin: str) -> DataFrame:
    """``name（origin）`` or ``name(origin)`` into two columns, else the name alone."""
    pattern = r"^(.+?)[（(](.+?)[）)](.*)$"
    plain = strip(F.coalesce(F.col(col), F.lit("")))
    head = F.regexp_extract(plain, pattern, 1)
    return df.withColumns({
        name: F.when(head != "", strip(head)).otherwise(plain),
        origin: strip(F.regexp_extract(plain, pattern, 2)),
    })


def rule_errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken, in order. A rule holds the condition of being wrong."""
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda e: e.isNotNull())


def quarantine(df: DataFrame, errors: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and bad rows with all their errors and ``error_count``. A null list is bad."""
    bad = F.coalesce(F.size(errors) > 0, F.lit(True)) | F.col(errors).isNull()
    return df.where(~bad).drop(errors), df.where(bad).withColumn("error_count", F.coalesce(F.size(errors), F.lit(0)))
