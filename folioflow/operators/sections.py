"""Fixed-heading documents: sections, heading checks, repair, dialogue and digests.

A document is one row, and every step works inside that row, so nothing here shuffles texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import clip_sentence, contains_any, in_parentheses, starts_with_any, strip


def section_array(text: Column, mark: str = "## ") -> Column:
    """Array of ``struct<heading,body>``; element 0 is the text before the first heading."""
    parts = F.split(F.concat(F.lit("\n"), text), "\n\\Q" + mark + "\\E")
    return F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("")).otherwise(strip(F.substring_index(p, "\n", 1))).alias("heading"),
        strip(F.when(i == 0, p).when(p.contains("\n"), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(F.lit(""))).alias("body")))


def section_table(docs: DataFrame, keys: list[str], text: str, mark: str = "## ") -> DataFrame:
    """One row per section: ``ord``, ``heading``, ``body``."""
    return docs.select(*keys, F.posexplode(section_array(F.col(text), mark)).alias("ord", "_s")).select(*keys, "ord", "_s.*")


def section_body(text: Column, title: str, mark: str = "## ") -> Column:
    """Body of the first section of that title, empty if there is none."""
    hit = F.filter(section_array(text, mark), lambda s: s["heading"] == title)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["body"], F.lit(""))


def heading_errors(text: Column, headings: list[str], mode: str = "substring", advance_on_error: bool = False) -> Column:
    """``missing h`` and ``order h`` in heading order. ``mode='line'`` takes whole lines only.

    A heading out of order moves the pointer only with ``advance_on_error``.
    """
    hay = text if mode == "substring" else F.concat(F.lit("\n"), text, F.lit("\n"))

    def place(h):
        # bytes before the heading, counted from 1; a byte search is much faster than instr on long texts
        ahead = F.octet_length(F.substring_index(hay, h if mode == "substring" else f"\n{h}\n", 1))
        return F.when(ahead < F.octet_length(hay), ahead + 1).otherwise(F.lit(0))

    found = F.array(*[F.struct(F.lit(h).alias("h"), place(h).alias("i")) for h in headings])
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("errs"))

    def step(acc, x):
        missing, late = x["i"] == 0, x["i"] <= acc["last"]
        err = F.when(missing, F.concat(F.lit("missing "), x["h"])).when(late, F.concat(F.lit("order "), x["h"]))
        moved = F.when(missing, acc["last"]).when(late, x["i"] if advance_on_error else acc["last"]).otherwise(x["i"])
        return F.struct(moved.alias("last"), F.when(err.isNull(), acc["errs"]).otherwise(F.concat(acc["errs"], F.array(err))).alias("errs"))

    return F.aggregate(found, start, step, lambda acc: acc["errs"])


def check_headings(docs: DataFrame, text: str, headings: list[str], summary: str | None = None, mode: str = "substring") -> DataFrame:
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    errs = F.when(blank, F.array(F.lit("content blank"))).otherwise(heading_errors(F.col(text), headings, mode))
    if summary:
        errs = F.concat(errs, F.when(strip(F.coalesce(F.col(summary), F.lit(""))) == "", F.array(F.lit("summary blank"))).otherwise(F.array().cast("array<string>")))
    return docs.withColumn("errors", errs)


def known_sections(text: Column, headings: list[str]) -> tuple[Column, Column]:
    """Text before the first known heading, and ``struct<heading,body>`` per known heading in text order.

    Only the first line of each known heading, at whatever level, cuts. Other headings, a known one that
    comes again, and the rest of a heading's own line stay in the text they stand in.
    """
    mark = headings[0].split(" ")[0] + " "
    titles = "|".join(r"\Q" + h.lstrip("#").strip() + r"\E" for h in sorted(headings, key=len, reverse=True))
    # two private letters show where a heading begins and ends
    parts = F.split(F.regexp_replace(text, rf"(?m)^#+\s*({titles})", "\ue000$1\ue001"), "\ue000")
    start = F.array().cast("array<struct<heading:string,body:string>>")

    def step(acc, p):
        title, rest = F.substring_index(p, "\ue001", 1), F.substring_index(p, "\ue001", -1)
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["heading"].alias("heading"), F.concat(last["body"], F.lit(mark), title, rest).alias("body"))
        new = F.array(F.struct(title.alias("heading"), rest.alias("body")))
        again = F.exists(acc, lambda s: s["heading"] == title)
        return F.when(again, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, new))

    cut = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    return strip(F.get(parts, F.lit(0))), F.transform(cut, lambda s: F.struct(s["heading"].alias("heading"), strip(s["body"]).alias("body")))


def repair_headings(docs: DataFrame, text: str, headings: list[str], fallbacks: dict[str, Column], none: str = fixed.NO_TEXT) -> DataFrame:
    """Sections in canonical order under their heading; blank ones filled from columns.

    Headings of another level are set right; text before the first heading goes to the first
    section if that is absent. Headings must share one mark (``## ``). See ``known_sections`` for
    what cuts: text under other or repeated headings is kept. A null text counts as blank.
    """
    lead, secs = known_sections(F.coalesce(F.col(text), F.lit("")), headings)
    d = docs.withColumns({"_lead": lead, "_secs": secs})

    def piece(i, h):
        title = h.lstrip("#").strip()
        hit = F.try_element_at(F.filter(F.col("_secs"), lambda s: s["heading"] == title), F.lit(1))
        content = F.coalesce(hit["body"], F.col("_lead") if i == 0 else F.lit(""))
        spare = F.coalesce(F.when(fallbacks[h] != "", fallbacks[h]) if h in fallbacks else F.lit(None), F.lit(none))
        return F.concat(F.lit(h + "\n"), F.when(content == "", spare).otherwise(content))

    return d.withColumn(text, F.concat_ws("\n\n", *[piece(i, h) for i, h in enumerate(headings)])).drop("_secs", "_lead")


def ensure_headings(docs: DataFrame, text: str, headings: list[str], fallbacks: dict[str, Column]) -> DataFrame:
    """Lighter repair of overview and page texts: an absent first heading goes on top, other absent
    ones are added at the end with their fallback text. A heading counts as present wherever its
    text occurs, so one that is a level too deep stays as it is."""
    d = docs
    for i, h in enumerate(headings):
        c = F.col(text)
        added = F.concat(F.lit(h + "\n\n"), strip(c)) if i == 0 else F.concat(strip(c), F.lit("\n\n" + h + "\n\n"), fallbacks.get(h, F.lit("")))
        d = d.withColumn(text, F.when(c.contains(h), c).otherwise(added))
    return d


def summary_fallback(summary: Column, source: Column, content: Column, default: Column) -> Column:
    """Summary, else first 30 characters of the source summary, else of the first plain line."""
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda s: (s != "") & ~s.startswith("#"))
    first = F.substring(F.try_element_at(lines, F.lit(1)), 1, 30)
    ok = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", c)
    return F.coalesce(ok(summary), ok(F.substring(strip(source), 1, 30)), first, default)


def dialogue_table(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Spoken lines of a dialogue section: ``pos``, ``speaker``, ``text``.

    Split at the first full-width colon, else the first plain one; none-markers and notes in
    parentheses are skipped; a line without a colon has speaker ``?``.
    """
    bullets = r"^[-*• ]+"
    note = lambda s, words: in_parentheses(s) & contains_any(s, words)
    d = docs.select(*keys, F.posexplode(F.split(body, "\n")).alias("pos", "_l"))
    d = d.withColumn("_s", strip(F.col("_l")))
    d = d.where((F.col("_s") != "") & ~starts_with_any(F.col("_s"), fixed.NONE_PREFIXES) & ~note(F.col("_s"), fixed.NOTE_WORDS))
    d = d.withColumn("_s", strip(F.regexp_replace("_s", bullets, "")))
    d = d.where(~note(F.col("_s"), fixed.NOTE_WORDS))
    colon = F.when(F.col("_s").contains("："), "：").when(F.col("_s").contains(":"), ":")
    at = F.locate("：", F.col("_s")), F.locate(":", F.col("_s"))
    cut = F.when(at[0] > 0, at[0]).otherwise(at[1])
    d = d.select(
        *keys, "pos", F.when(colon.isNull(), "?").otherwise(strip(F.substring(F.col("_s"), F.lit(1), cut - 1))).alias("speaker"),
        F.when(colon.isNull(), F.col("_s")).otherwise(strip(F.substring(F.col("_s"), cut + 1, F.length("_s")))).alias("text"))
    tail_words = [w for w in fixed.NOTE_WORDS if len(w) <= 2]
    return d.where((F.col("text") != "") & ~note(F.col("text"), tail_words) & ~starts_with_any(F.col("text"), fixed.NONE_PREFIXES))


def panel_digest(docs: DataFrame, text: str, cast_title: str, gist_titles: list[str], limit: int = 80, none: str = fixed.NO_GIST) -> DataFrame:
    """Number of people named in the cast section and a short gist of the first filled section."""
    d = docs.withColumn("_secs", section_array(F.col(text)))

    def body(title):
        hit = F.filter(F.col("_secs"), lambda s: s["heading"] == title)
        return F.coalesce(F.try_element_at(hit, F.lit(1))["body"], F.lit(""))

    lines = F.transform(F.split(body(cast_title), "\n"), lambda s: strip(F.regexp_replace(strip(s), r"^[-*• ]+", "")))
    people = F.size(F.filter(lines, lambda s: (s != "") & ~starts_with_any(s, fixed.NONE_PREFIXES)))
    gist = F.lit("")
    for title in reversed(gist_titles):
        gist = F.when(body(title) != "", body(title)).otherwise(gist)
    d = d.withColumns({"people": people, "_gist": strip(F.regexp_replace(gist, r"\s+", " "))})
    short = clip_sentence(F.col("_gist"), limit)
    return d.withColumn("gist", F.when(F.col("_gist") == "", none).otherwise(short)).drop("_secs", "_gist")
