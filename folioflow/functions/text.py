"""String and tag expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

_CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\u3000-\\u303f\\uff01-\\uffee]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.trim(c, F.lit(" \t\n\x0b\x0c\r"))


def number(c: Column, kind: str) -> Column:
    """Number from a pattern match; no match (empty) gives null. Cheaper than a failing cast."""
    return F.when(c != "", c).try_cast(kind)


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def tokens(c: Column) -> Column:
    """Comma-separated tags as an array of trimmed, non-blank strings."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda t: t != "")


def unweight(t: Column) -> Column:
    """``(tag:1.2)`` -> ``tag``; ``name \\(work\\)`` -> ``name (work)``; ``(tag)`` -> ``tag``."""
    plain = F.replace(F.replace(strip(t), F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))
    weighted = F.regexp_extract(plain, r"^\((.+?):\s*-?\d+(?:\.\d+)?\)$", 1)
    wrapped = F.regexp_extract(plain, r"^\((.+)\)$", 1)
    return strip(F.when(weighted != "", weighted).when(wrapped != "", wrapped).otherwise(plain))


def tag_set(c: Column) -> Column:
    """Distinct lower-case tags without weight shells."""
    return F.array_distinct(F.transform(tokens(c), lambda t: F.lower(unweight(t))))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(_CJK)


def drop_cjk_tags(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: ~t.rlike(_CJK)), ", ")


def bare_name(c: Column) -> Column:
    """Name without white space and punctuation, for loose comparison."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s·・。.,，:：'\"“”()（）]", "")


def clip_sentence(c: Column, limit: int) -> Column:
    """First ``limit`` characters, cut back to a sentence end in the second half if there is one."""
    full = strip(c)
    head = F.substring(full, 1, limit)
    cut = F.lit(None).cast("int")
    # fixed values: sentence ends, in order of preference
    for end in ["。", "！", "？", "；", ". "]:
        tail = F.instr(F.reverse(head), end[::-1])
        at = F.lit(limit) - tail - len(end) + 1
        cut = F.coalesce(cut, F.when((tail > 0) & (at > limit // 2), at + len(end)))
    clipped = F.concat(F.when(cut.isNotNull(), F.substring(head, F.lit(1), cut)).otherwise(head), F.lit("……"))
    return F.when(F.length(full) <= limit, full).otherwise(clipped)


def unit_path(c: Column) -> Column:
    """Path of a unit file in one spelling."""
    p = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"^s2_zero/", "")
    return F.when(p == "00_settings.md", F.lit("00_settings.json")).otherwise(p)


def page_of_path(c: Column) -> Column:
    page = F.regexp_extract(c, r"^02_pages/page_(\d+)\.md$", 1)
    panel = F.regexp_extract(c, r"^03_panels/p(\d{3})_\d{2}\.md$", 1)
    return F.when(page != "", page.try_cast("int")).when(panel != "", panel.try_cast("int"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``<<KEY>>``; unknown keys stay in place."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit(f"<<{key}>>"), value)
    return out


def unfilled(c: Column) -> Column:
    """Names of the ``<<KEY>>`` marks still in a text."""
    return F.regexp_extract_all(c, F.lit("<<([A-Za-z_][A-Za-z0-9_]*)>>"), 1)


def in_parentheses(c: Column) -> Column:
    return (c.startswith("（") & c.endswith("）")) | (c.startswith("(") & c.endswith(")"))


def starts_with_any(c: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.startswith(m)
    return out


def contains_any(c: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.contains(m)
    return out


def synonym(c: Column, words: dict[str, list[str]]) -> Column:
    """Canonical word of a synonym list, else null."""
    low = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for canon, alts in words.items():
        out = F.coalesce(out, F.when(low.isin(alts), F.lit(canon)))
    return out


def gender(c: Column) -> Column:
    return F.coalesce(synonym(c, fixed.GENDER_WORDS), F.lit("unknown"))


def count(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    return F.size(F.split(c, "\\Q" + needle + "\\E")) - 1
