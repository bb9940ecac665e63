"""Whole stages as compositions of the operators. Each returns named DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import tag_set
from ..operators import aggregates as ag, assembly as asm, intervals as iv, joins, rules, sections as sc, segments as sg, shape, sorting, windows as wn
from ..operators.repair import repair_loop, repair_video_prompt
from ..session import cut_lineage
from ..sources import assets as src, documents as docs


def ingest(files: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """Numbered assets of the best folder: manifest (last file of a number wins), gaps, totals."""
    found = src.numbered_assets(files, path)
    chosen = found.join(src.pick_asset_root(found).select("dir"), "dir", "left_semi")
    manifest = wn.last_wins(chosen.select("number", "file", path), ["number"], ["file"])
    return {
        "manifest": manifest, "gaps": iv.sequence_gaps(chosen, [], "number"),
        "totals": ag.manifest_rollup(manifest, [], F.col("replaced") > 0, "number"),
    }


def understand(replies: DataFrame, raw: str, page: str, page_w: str, page_h: str) -> dict[str, DataFrame]:
    """Model replies with a page layout -> panels with pixel rectangles; bad replies apart.

    ``layout`` errors are found first; only pages without any go on.
    """
    schema = "summary STRING, panels ARRAY<STRUCT<no: INT, bbox: ARRAY<DOUBLE>, shape: STRING>>"
    parsed, unreadable = docs.json_value(replies, raw, schema, "layout")
    parsed = parsed.select(page, page_w, page_h, F.col("layout.summary").alias("summary"), F.col("layout.panels").alias("panels"))
    parsed = cut_lineage(parsed)  # replies are parsed once, the checks below read them several times
    panels = parsed.select(page, page_w, page_h, F.inline("panels")).select(
        page, page_w, page_h, "no", "shape", *[F.try_element_at("bbox", F.lit(i + 1)).alias(c) for i, c in enumerate("xywh")])
    errors = cut_lineage(rules.check_layout(parsed.select(page, "summary"), panels, page, "no", "x", "y", "w", "h", "shape", "summary"))
    good = shape.clamp_boxes(panels.join(errors, page, "left_anti"), "x", "y", "w", "h")
    good = shape.crop_rects(good, "x", "y", "w", "h", page_w, page_h, "shape")
    return {"panels": good.withColumn("key", F.format_string("p%03d_%02d", page, "no")), "errors": errors, "unreadable": unreadable}


def settings_and_scripts(
    mentions: DataFrame, entity: str, order: list[str], attrs: list[str], states: DataFrame, required: DataFrame, pos: str, first: int, last: int,
    scripts: DataFrame, key: str, text: str, spare: dict[str, Column], dialogue: DataFrame, wanted: str,
) -> dict[str, DataFrame]:
    """Merged entities, repaired states, and scripts after the check-repair loop and the static gate."""
    heads = fixed.PANEL_HEADINGS
    looped = repair_loop(scripts, lambda d: sc.check_headings(d, text, heads), lambda d: sc.repair_headings(d, text, heads, spare))
    return {
        "entities": ag.merge_entities(mentions, entity, order, attrs),
        "states": iv.repair_states(states, required, [entity], pos, first, last), "scripts": looped,
        "issues": rules.check_static(scripts.select(key), looped, dialogue, key, text, wanted, heads),
    }


def prompts(panels: DataFrame, mentions: DataFrame, entities: DataFrame, states: DataFrame, panel: str, entity: str, page: str, order: list[str], run_id: str, blocks=None) -> dict[str, DataFrame]:
    """Resolved cast, assembled prompts, and the tags that a prompt should hold but lacks."""
    cast = asm.resolve_entities(mentions, entities, states, entity, page, ["state_tags"]).withColumn("state_tags", F.coalesce("state_state_tags", F.lit("")))
    cast = cut_lineage(cast)  # stored rows, as the tags are read again below
    made = cut_lineage(asm.assemble_prompts(panels, cast, panel, order, run_id, blocks=blocks))
    # tags are compared inside the row: the rows of all tags of all prompts are many times what their size on disk tells
    need = cast.select(panel, entity, tag_set(F.concat_ws(",", "tags", "state_tags")).alias("_need"))
    have = made.groupBy(panel).agg(F.flatten(F.collect_list(tag_set(F.col("positive")))).alias("_have"))
    lacks = F.filter("_need", lambda tag: ~F.coalesce(F.array_contains("_have", tag), F.lit(False)))
    return {"cast": cast, "prompts": made, "missing": need.join(have, panel, "left").select(panel, entity, F.explode(lacks).alias("tag"))}


def attempts(prompts_df: DataFrame, seed: str, results: DataFrame, unit: list[str]) -> dict[str, DataFrame]:
    """Attempt plan, outcome per unit and health figures."""
    outcome = ag.final_attempt(results, unit, "attempt", "passed", "points", "infra")
    return {"plan": sg.explode_attempts(prompts_df, seed), "outcome": outcome, "health": ag.attempt_qc(outcome)}


def typesetting(details: DataFrame, keys: list[str], sizes: Callable[[DataFrame], DataFrame], placements: DataFrame, panel: str) -> dict[str, DataFrame]:
    """Lines per panel; the default layout where the model's places are not usable."""
    lines = shape.flatten_lines(shape.coerce_detail(details), keys, "dialogue", "onomatopoeia")
    expected = lines.groupBy(panel).agg(F.count(F.lit(1)).alias("n_lines"))
    verdict = rules.check_placements(placements, expected, panel, "n_lines", "x", "y", "w", "h")
    fall = sizes(lines.join(verdict.where("layout = 'fallback'"), panel, "left_semi"))
    return {"lines": lines, "verdict": verdict, "layout": wn.stack_layout(fall, [panel], "kind", [k for k in keys if k != panel] + ["idx"], "bw", "bh", "pw", "ph")}


def segments(units: DataFrame, keys: list[str], unit: str, order: list[str]) -> dict[str, DataFrame]:
    """Fallback segmentation of ordered units, and its check against the units."""
    packed = cut_lineage(sg.pack_sequential(units, keys, order))
    segs = packed.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("n_units"), (F.count(F.lit(1)) * fixed.UNIT_SECONDS).alias("duration"))
    segs = segs.withColumn("beat", F.lit(fixed.FALLBACK_BEAT))
    errors = rules.check_segments(segs, packed, units, keys, seg="seg", place=["seg"], duration="duration", beat="beat", unit=unit, order=["seg", "pos"], unit_order=order)
    return {"segments": sg.half_split(segs, [*keys, "seg"], "n_units", "duration"), "units": packed, "errors": errors}


def video_prompts(prompts_df: DataFrame) -> dict[str, DataFrame]:
    """Check, repair what fails, check again."""
    cols = ("prompt", "mode", "duration", "dialogue", "names")
    check = lambda d: d.withColumn("errors", rules.prompt_errors(*[F.col(c) for c in cols]))
    done = repair_loop(prompts_df, check, lambda d: repair_video_prompt(d, *cols))
    return {"prompts": done, "rollup": ag.check_rollup(done, ["mode"], "initial", "final")}


def render(segs: DataFrame, frames: DataFrame, seg: str, produced: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Render parameters with the mode settled by the first frame, and what is still missing."""
    d = joins.pick_mode(segs, frames, seg, "style")
    jobs = shape.render_jobs(d, run_id, seg=seg)
    return {"jobs": jobs, "missing": joins.missing_expected(segs.select(seg), produced, [seg])}


def timeline(clips: DataFrame, keys: list[str], order: list[str], log: str, actual: str, blocks=None) -> dict[str, DataFrame]:
    """Clip facts from probe texts, consistency, cross-fades, and planned against actual length."""
    media = asm.media_from_logs(clips, log)
    total = wn.crossfade_total(media, keys, "duration")
    known = clips.groupBy(*keys).agg(F.max(actual).alias("_actual"))
    return {
        "consistency": ag.media_consistency(media, keys, order), "offsets": wn.crossfade_offsets(media, keys, order, "duration", blocks=blocks),
        "length": rules.check_duration(total.join(known, keys), "_actual", "total"),
    }


def page_layout(panels: DataFrame, pages: DataFrame, page: str, variants: DataFrame, panel: str) -> DataFrame:
    """Panel places on the page, with the typeset image where there is one."""
    placed = shape.layout_rects(panels, pages, [page], "x", "y", "w", "h", "page_w", "page_h")
    return joins.prefer_variant(placed, variants, [panel], ["image"])


def run_status(stage_ledger: DataFrame, run: str) -> DataFrame:
    """One line per run: stage strip, next stage, ready and skipped stages."""
    current = stage_ledger.groupBy(run, "stage").agg(F.max_by("status", "ts").alias("status"))
    states = joins.stage_states(stage_ledger, run, "stage", "status").groupBy(run).agg(
        F.count_if(F.col("state") == "ready").alias("n_ready"), F.count_if(F.col("state") == "skipped").alias("n_skipped"))
    return (sorting.stage_strip(current, run, "stage", "status").join(sorting.next_pending(current, run, "stage", "status"), run).join(states, run))
