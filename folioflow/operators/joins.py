"""Lookups between units, ledgers, names, mentions and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import bare_name, contains_any, in_parentheses, strip
from ..session import cut_lineage


def _runs(name: Column, width: Column) -> Column:
    """Distinct runs of ``width`` letters of a name at least that long."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - width + 1), lambda i: F.substring(name, i, width)))


def _inside(longer: DataFrame, l: str, shorter: DataFrame, s: str) -> DataFrame:
    """Pairs where the name ``s`` (two letters or more) lies inside the name ``l``.

    Long names stand in an index under their runs of two and three letters, so rows grow with the letters.
    A short name looks under one run only, that of the fewest long names; one it has alone rules it out.
    """
    name, n = F.col(l), F.length(l)
    three = F.when(n >= 3, _runs(name, F.lit(3))).otherwise(F.array().cast("array<string>"))
    index = longer.where(n >= 2).select(l, F.explode(F.concat(_runs(name, F.lit(2)), three)).alias("_g"))
    held = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = shorter.where(F.length(s) >= 2).select(s, F.explode(_runs(F.col(s), F.least(F.length(s), F.lit(3)))).alias("_g"))
    rarest = own.join(held, "_g", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
    return index.join(rarest.where("_r.n > 0").select(s, "_r._g"), "_g").where(name.contains(F.col(s))).select(l, s)


def fuzzy_name_join(a: DataFrame, a_name: str, b: DataFrame, b_name: str) -> DataFrame:
    """Distinct name pairs that are equal without punctuation, or one inside the other (both >= 2 long).

    Containment is looked up in an index of letter runs and then tested, once in each direction.
    """
    x = a.select(F.col(a_name).alias("a"), bare_name(F.col(a_name)).alias("_x")).where("_x <> ''").distinct()
    y = b.select(F.col(b_name).alias("b"), bare_name(F.col(b_name)).alias("_y")).where("_y <> ''").distinct()
    xs, ys = x.select("_x").distinct(), y.select("_y").distinct()
    same = xs.join(ys, F.col("_x") == F.col("_y"))
    pairs = same.unionByName(_inside(xs, "_x", ys, "_y")).unionByName(_inside(ys, "_y", xs, "_x")).distinct()
    return pairs.join(x, "_x").join(y, "_y").select("a", "b")


def fuzzy_matches_or_all(a: DataFrame, a_name: str, b: DataFrame, b_name: str) -> DataFrame:
    """As above; a name without a hit keeps one row with ``b`` null, which stands for all of b."""
    pairs = fuzzy_name_join(a, a_name, b, b_name)
    return a.select(F.col(a_name).alias("a")).distinct().join(pairs, "a", "left")


def phrase_hits(docs: DataFrame, doc: str, text: str, phrases: DataFrame, pid: str, phrase: str) -> DataFrame:
    """Every (document, phrase) where the phrase occurs in the text, whole texts, any position.

    Documents and phrases meet by equality on one word, then ``contains`` decides. A text that holds a phrase of
    several words has a word that ends with the first one, one that starts with the last one, and the inner
    ones as they are; a single word lies inside a word. Of the inner words and the longer end the one found in the
    fewest documents is taken, and one in none rules the phrase out. These parts are looked up in the distinct
    words of the corpus, not in each text. Texts are joined last and once, to the pairs left.
    """
    words = docs.select(doc, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("_w"))
    vocab = cut_lineage(words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")), "vocab")
    p = phrases.where(strip(F.col(phrase)) != "").select(F.col(pid), F.col(phrase).alias("_phrase"))
    p = p.withColumn("_t", F.split("_phrase", r"\s+")).withColumn("_k", F.size("_t"))
    first, last = F.get("_t", F.lit(0)), F.element_at("_t", -1)

    def part(kind, c):
        return F.struct(F.lit(kind).alias("kind"), c.alias("_s"))

    whole = F.transform(F.slice("_t", F.lit(2), F.greatest(F.col("_k") - 2, F.lit(0))), lambda x: part("whole", x))
    ends = F.array(F.when(F.length(last) >= F.length(first), part("start", last)).otherwise(part("end", first)))
    ends = F.filter(ends, lambda x: (F.length(x["_s"]) >= 3) | ((F.col("_k") == 2) & (x["_s"] != "")))  # inner words say more than one or two letters
    # phrases of one id are one entry each, told by their text
    parts = p.select(pid, "_phrase", F.inline(F.when(F.col("_k") == 1, F.array(part("inside", last))).otherwise(F.concat(whole, ends)))).distinct()
    wanted = cut_lineage(parts.select("kind", "_s").distinct(), "parts")
    # one entry per kind and length in use, so the set stays small
    lengths = wanted.agg(F.collect_set(F.struct("kind", F.length("_s").alias("_m"))).alias("_l")).scalar()
    n = F.length("_w")
    cut = vocab.select("_w", "_n", lengths.alias("_l")).select("_w", "_n", F.inline(F.filter("_l", lambda x: F.when(x["kind"] == "whole", x["_m"] == n).otherwise(x["_m"] <= n))))
    at = F.when(F.col("kind") == "end", F.array(n - F.col("_m") + 1)).when(F.col("kind") == "inside", F.sequence(F.lit(1), n - F.col("_m") + 1)).otherwise(F.array(F.lit(1)))
    cut = cut.select("_w", "_n", "kind", "_m", F.explode(at).alias("_i")).select("_w", "_n", "kind", F.substring(F.col("_w"), F.col("_i"), F.col("_m")).alias("_s"))
    found = cut_lineage(cut.join(wanted, ["kind", "_s"]), "found")
    held = found.groupBy("kind", "_s").agg(F.sum("_n").alias("_n"))
    rarest = parts.join(held, ["kind", "_s"], "left").groupBy(pid, "_phrase").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "kind", "_s")).alias("_r"))
    anchors = rarest.where("_r.n > 0").select(pid, "_phrase", "_r.kind", "_r._s").join(found, ["kind", "_s"]).select(pid, "_phrase", "_w").distinct()
    anchors = cut_lineage(anchors, "anchors")  # stored, so that their size is known before all words of all texts are shuffled to them
    pairs = words.join(anchors, "_w").select(doc, pid, "_phrase").distinct()
    texts = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    hit = (F.col(doc) == F.col("_doc")) & F.col("_text").contains(F.col("_phrase"))
    return pairs.join(texts, hit).select(doc, pid)


def mention_join(sections: DataFrame, sec: str, text: str, aliases: DataFrame, entity: str, ord: str, alias: str) -> DataFrame:
    """Entities named in a section (letter case ignored), dictionary order kept in ``ord``.

    A section without a hit gets one row: ``empty`` when it says that nobody is there, else
    ``needs_model``.
    """
    low = sections.select(sec, F.lower(text).alias("_low"))
    names = aliases.select(entity, ord, F.lower(alias).alias("_alias")).where(strip(F.col("_alias")) != "").withColumn(
        "_aid", F.concat_ws("\u0001", F.col(entity).cast("string"), F.col(ord).cast("string"), "_alias")).distinct()
    hits = phrase_hits(low, sec, "_low", names, "_aid", "_alias").join(names, "_aid").groupBy(sec, entity).agg(F.min(ord).alias(ord))
    compact = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")
    nobody = (strip(F.col(text)) != "") & ((F.length(compact) <= 2) | contains_any(F.col(text), fixed.EMPTY_CAST_MARKERS))
    rest = sections.join(hits.select(sec).distinct(), sec, "left_anti").select(
        sec, F.lit(None).cast(hits.schema[entity].dataType).alias(entity), F.lit(None).cast(hits.schema[ord].dataType).alias(ord),
        F.when(nobody, "empty").otherwise("needs_model").alias("outcome"))
    return hits.withColumn("outcome", F.lit("matched")).unionByName(rest)


def resume(todo: DataFrame, ledger: DataFrame, outputs: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Units still to do: skip one only if the ledger says completed and its output exists."""
    done = ledger.where(F.col(status) == "completed").select(*keys).join(outputs.select(*keys), keys, "left_semi")
    return todo.join(done, keys, "left_anti")


def missing_expected(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(produced, keys, "left_anti")


def pick_mode(segments: DataFrame, frames: DataFrame, seg: str, style: str) -> DataFrame:
    """Flat style with an existing first frame starts from the picture, all else from text."""
    have = frames.select(seg).distinct().withColumn("_frame", F.lit(True))
    d = segments.join(have, seg, "left")
    with_frame = (F.col(style) == "2d") & F.col("_frame").isNotNull()
    return d.withColumn("mode", F.when(with_frame, "i2va").otherwise("t2va")).drop("_frame")


def prefer_variant(base: DataFrame, variant: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The variant's columns where it has the unit, else the base's."""
    v = variant.select(*keys, *[F.col(c).alias("_v_" + c) for c in cols], F.lit(True).alias("_has"))
    d = base.join(v, keys, "left")
    picked = [F.when(F.col("_has"), F.col("_v_" + c)).otherwise(F.col(c)).alias(c) for c in cols]
    return d.select(*[c for c in base.columns if c not in cols], *picked, F.coalesce("_has", F.lit(False)).alias("is_variant"))


def is_required_text(c: Column) -> Column:
    """Not blank, not wholly in parentheses, not a "none" marker."""
    s = strip(F.coalesce(c, F.lit("")))
    return (s != "") & ~s.isin(fixed.NONE_MARKERS) & ~in_parentheses(s)


def verbatim_missing(required: DataFrame, docs: DataFrame, keys: list[str], wanted: str, text: str) -> DataFrame:
    """Required texts that their own document does not hold literally, or whose document is null or absent."""
    r = required.withColumn("_w", strip(F.coalesce(F.col(wanted), F.lit("")))).where(is_required_text(F.col(wanted)))
    return r.join(docs.select(*keys, F.col(text).alias("_doc")), keys, "left").where(~F.coalesce(F.col("_doc").contains(F.col("_w")), F.lit(False))).drop("_doc", "_w")


def attach_style(df: DataFrame, style: str, text: str, guards: dict[str, str] = fixed.STYLE_GUARDS) -> DataFrame:
    """Append the guard text of the style where it is missing; an unknown style gives an error."""
    table = F.create_map(*[F.lit(x) for kv in guards.items() for x in kv])
    d = df.withColumn("_g", F.try_element_at(table, F.col(style)))
    guarded = F.when(F.col("_g").isNull() | F.col(text).contains(F.col("_g")), F.col(text)).otherwise(
        F.concat_ws(" ", text, "_g"))
    return d.withColumns({
        text: guarded, "style_error": F.when(F.col("_g").isNull(), F.concat(F.lit("unknown style "), F.coalesce(F.col(style), F.lit("?")))),
    }).drop("_g")


def final_units(ledger: DataFrame, processed: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Units in a final state that the next stage has not handled yet."""
    final = ledger.where(F.col(status).isin("completed", "needs_review")).select(*keys).distinct()
    return final.join(processed, keys, "left_anti")


def panel_context(panels: DataFrame, pages: DataFrame, cards: DataFrame, page: str, entity: str) -> DataFrame:
    """One row per panel and relevant card, with the text of its page."""
    return panels.join(pages, page).join(cards, entity, "left")


def stage_states(
    ledger: DataFrame, run: str, stage: str, status: str,
    stages: list[str] = fixed.STAGES, deps: list[tuple[str, str]] = fixed.STAGE_DEPS,
) -> DataFrame:
    """Per run and stage what the scheduler would do: completed, failed, skipped, ready or waiting.

    A stage downstream of a failed or skipped one is skipped; one with all dependencies
    completed is ready. Dependencies outside ``stages`` do not count.
    """
    per = [F.max_by(status, F.when(F.col(stage) == s, F.col("ts"))).alias(f"_{s}") for s in stages]
    d = ledger.groupBy(run).agg(*per)
    for s in stages:
        up = [F.col(f"_{dep}") for st, dep in deps if st == s and dep in stages]
        broken, ok = F.lit(False), F.lit(True)
        for u in up:
            broken = broken | u.isin("failed", "skipped")
            ok = ok & (u == "completed")
        own = F.col(f"_{s}")
        d = d.withColumn(f"_{s}", F.when(own.isin("completed", "failed"), own).when(broken, "skipped").when(ok, "ready").otherwise("waiting"))
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"_{s}").alias("state")) for s in stages])
    return d.select(run, F.inline(rows))


def ready_stages(*args, **kw) -> DataFrame:
    return stage_states(*args, **kw).where("state = 'ready'").drop("state")


def skip_cascade(*args, **kw) -> DataFrame:
    return stage_states(*args, **kw).where("state = 'skipped'").drop("state")
