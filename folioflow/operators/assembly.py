"""Assembly of prompt records, cards and media facts from their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import boxes, fixed, seeds
from ..functions.clock import clock_seconds
from ..functions.text import drop_cjk_tags, gender, number, strip, tokens
from .aggregates import count_text, opposite_text, ordered_concat
from .intervals import state_at
from .scan import numbered


def resolve_entities(mentions: DataFrame, entities: DataFrame, states: DataFrame, entity: str, page: str, state_payload: list[str], policy: str = "latest_listed") -> DataFrame:
    """Mentions with the current entity columns, the state at their page and a clean anchor."""
    d = state_at(mentions, states, [entity], page, payload=state_payload, policy=policy)
    return d.join(entities, entity).withColumn("anchor", drop_cjk_tags(F.col("anchor")))


def quality_tail(tail: Column) -> Column:
    """Tail tags with a comma on both ends."""
    t = strip(F.coalesce(tail, F.lit("")))
    t = F.when(t == "", fixed.QUALITY_TAIL).otherwise(t)
    t = F.when(t.startswith(","), t).otherwise(F.concat(F.lit(","), t))
    return F.when(t.endswith(","), t).otherwise(F.concat(t, F.lit(",")))


def positive_text(count: Column, blocks: Column, scene: Column, tail: Column) -> Column:
    """Count tag, entity blocks, scene and tail as one prompt text."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    bare = F.regexp_replace(strip(F.coalesce(scene, F.lit(""))), ",+$", "")
    return F.concat(F.concat_ws(", ", filled(count), filled(blocks), filled(bare)), tail)


def entity_block(anchor: Column, tags: Column, state_tags: Column) -> Column:
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(", ", filled(anchor), filled(tags), filled(state_tags))


def cast_texts(cast: DataFrame, panel: str, order: list[str], block: Column, sex: str, entity: str | None = None, known: Column | None = None, blocks=None) -> DataFrame:
    """One row per panel: blocks of the cast in order, counts of both sexes (of ``known`` members), anchors, names.

    A large cast is numbered by the scan, put together in parts of 1000 members, and the parts of a panel are then
    joined, so all is read once and no task holds the members of a panel, only its finished texts.
    """
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    name = F.col(entity).cast("string") if entity else F.lit(None).cast("string")
    d = cast.select(panel, *order, filled(block).alias("_line"), filled(F.col("anchor")).alias("_anchor"), name.alias("_name"),
                    F.when(known if known is not None else F.lit(True), gender(F.col(sex))).alias("_sex"))
    d = numbered(d, [panel], order, "_rn", blocks)
    rows = F.array_sort(F.collect_list(F.struct("_rn", "_line", "_anchor", "_name")))
    parts = d.groupBy(panel, F.floor((F.col("_rn") - 1) / 1000).alias("part")).agg(
        rows.alias("_rows"), F.count_if(F.col("_sex") == "female").alias("_f"), F.count_if(F.col("_sex") == "male").alias("_m"), F.count("_sex").alias("_known"))
    column = lambda f: F.filter(F.transform("_rows", lambda r: r[f]), lambda x: x.isNotNull())
    parts = parts.select(panel, "_f", "_m", "_known", F.struct(
        "part", F.nullif(F.array_join(column("_line"), ", "), F.lit("")).alias("text"), column("_anchor").alias("anchors"), column("_name").alias("names")).alias("_p"))
    whole = parts.groupBy(panel).agg(F.array_sort(F.collect_list("_p")).alias("_ps"), F.sum("_f").alias("_f"), F.sum("_m").alias("_m"), F.sum("_known").alias("_known"))
    return whole.select(
        panel, "_f", "_m", "_known", F.array_join(F.transform("_ps", lambda p: p["text"]), ", ").alias("text"),
        F.flatten(F.transform("_ps", lambda p: p["anchors"])).alias("anchors"), F.flatten(F.transform("_ps", lambda p: p["names"])).alias("names"))


def assemble_prompts(
    panels: DataFrame, resolved: DataFrame, panel: str, order: list[str], run_id: str, *, sex: str = "gender", tags: str = "tags",
    state_tags: str = "state_tags", scene: str = "scene", tail: str = "tail", negative: str = "negative", crop_w: str = "crop_w",
    crop_h: str = "crop_h", entity: str | None = None, carry: list[str] = (), blocks=None,
) -> DataFrame:
    """One prompt per panel, whatever the size of its cast; ``carry`` names columns of the panels to keep (page, order, ...)."""
    block = entity_block(F.col("anchor"), F.col(tags), F.col(state_tags))
    d = panels.join(cast_texts(resolved, panel, order, block, sex, entity, blocks=blocks), panel, "left")
    f, m = F.coalesce("_f", F.lit(0)), F.coalesce("_m", F.lit(0))
    count, bare, end = count_text(f, m), F.array_join(tokens(F.col(scene)), ", "), quality_tail(F.col(tail))
    shape = boxes.shape_of(F.col(crop_w), F.col(crop_h))
    none = F.array().cast("array<string>")
    neg = F.concat_ws(", ", opposite_text(f > 0, m > 0), F.nullif(F.col(negative), F.lit("")))
    return d.select(
        panel, *carry, count.alias("count_tag"), positive_text(count, F.col("text"), bare, end).alias("positive"), neg.alias("negative_text"),
        F.coalesce("anchors", none).alias("anchors"), F.coalesce("names", none).alias("characters"), bare.alias("scene_tags"), end.alias("quality_tail"),
        shape.alias("size_bucket"), boxes.bucket_side(shape, 0).alias("width"), boxes.bucket_side(shape, 1).alias("height"),
        F.when(shape.isNotNull(), F.round(F.col(crop_w) / F.col(crop_h), 4)).alias("crop_aspect"),
        seeds.seed32(F.concat(F.lit(run_id + ":"), F.col(panel).cast("string"))).alias("seed"))


def repair_prompts(prompts: DataFrame, cast: DataFrame, entities: DataFrame, panel: str, order: list[str]) -> DataFrame:
    """Rebuild prompts from the current entities: block, bucket, count tag; non-Latin tags leave scene and tail.

    One row per prompt, whatever the size of its cast. Entities that are not in the settings keep the block stored with the cast.
    """
    now = entities.select("name", *[F.col(c).alias("_n_" + c) for c in ("anchor", "tags", "state_tags", "gender")], F.lit(True).alias("_known"))
    d = cast.join(now, "name", "left")
    pick = lambda c: F.when(F.col("_known"), F.col("_n_" + c)).otherwise(F.col(c))
    d = d.withColumns({c: pick(c) for c in ("anchor", "tags", "state_tags", "gender")}).withColumn("anchor", drop_cjk_tags(F.col("anchor")))
    block = entity_block(F.col("anchor"), F.col("tags"), F.col("state_tags"))
    texts = cast_texts(d, panel, order, block, "gender", known=F.coalesce("_known", F.lit(False))).drop("anchors", "names")
    tail = F.replace(drop_cjk_tags(F.col("quality_tail")), F.lit(", "), F.lit(","))
    p = prompts.withColumns({"scene_tags": drop_cjk_tags(F.col("scene_tags")), "quality_tail": quality_tail(tail)})
    p = p.join(texts, panel, "left")
    shape = boxes.shape_of(F.col("crop_w"), F.col("crop_h"))
    p = p.withColumns({
        "count_tag": F.when(F.col("_known") > 0, count_text(F.col("_f"), F.col("_m"))).otherwise(F.col("count_tag")), "size_bucket": shape,
        "width": boxes.bucket_side(shape, 0), "height": boxes.bucket_side(shape, 1)})
    return p.withColumn("positive", positive_text(F.col("count_tag"), F.col("text"), F.col("scene_tags"), F.col("quality_tail"))).select(*prompts.columns)


def entity_card(name: Column, sex: Column, appearance: Column, states: Column, none: str = fixed.NO_STATES) -> Column:
    """Card text of one entity."""
    states = F.when(F.coalesce(states, F.lit("")) == "", F.lit(none)).otherwise(states)
    return F.concat(F.lit("### "), name, F.lit("（"), gender(sex), F.lit("）\n- "), appearance, F.lit("\n- "), states)


def roster_text(entities: DataFrame, keys: list[str], order: list[str], card: Column, part_rows: int = 1000) -> DataFrame:
    """Cards of a group in order, in numbered parts."""
    return ordered_concat(entities, keys, order, card, "\n", part_rows)


def media_from_logs(df: DataFrame, log: str) -> DataFrame:
    """Clip facts from a probe text, with defaults for what it does not say."""
    c = F.col(log)
    get = lambda p, g=1: F.regexp_extract(c, p, g)
    layout = get(r"\b(mono|stereo)\b")
    d = df.withColumn("_d", get(r"Duration:\s*(\d+:\d+:\d+(?:\.\d+)?)"))
    return d.withColumns({
        "duration": F.coalesce(clock_seconds(F.col("_d")), F.lit(0.0)),
        "w": F.coalesce(number(get(r"Video:\s*.*?(\d{2,5})x(\d{2,5})"), "int"), F.lit(0)),
        "h": F.coalesce(number(get(r"Video:\s*.*?(\d{2,5})x(\d{2,5})", 2), "int"), F.lit(0)),
        "fps": F.coalesce(number(get(r"(\d+(?:\.\d+)?)\s+fps"), "double"), number(get(r"(\d+(?:\.\d+)?)\s+tbr"), "double"), F.lit(fixed.FPS_DEFAULT)),
        "sample_rate": F.coalesce(number(get(r"(\d+)\s+Hz"), "int"), F.lit(fixed.RATE_DEFAULT)),
        "channels": F.when(layout == "", fixed.LAYOUT_DEFAULT).otherwise(layout),
        "has_audio": c.contains("Audio:"),
    }).drop("_d")
