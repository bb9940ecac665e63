"""Running values in key order that never put a whole key into one task.

A plain window partitioned by key sends every row of a hot key to one task. Keys of up to ``LARGE``
rows run in such a window, which shuffles their rows once. A larger key is
cut into blocks along its order; a window runs inside a block, one summary row per block is
carried over the earlier blocks, and the carry is joined back. Both steps are functions of the
row alone, so a lost executor recomputes the same blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: rows up to which a key is a task's share and is not cut into blocks
LARGE = 65536


def by_width(c: Column, *widths: int) -> list[Column]:
    """Blocks of a numeric order column, e.g. ``by_width(c, 65536)``."""
    return [F.floor(c / w).cast("bigint") for w in widths]


def _same(left, right, cols):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right["_j_" + c]) for c in cols])


def _attach(df: DataFrame, carry: DataFrame, cols: list[str]) -> DataFrame:
    """Left join on equal (null-safe) columns, keeping the left names only once."""
    renamed = carry.select(
        *[F.col(c).alias("_j_" + c) for c in cols], *[c for c in carry.columns if c not in cols]
    )
    return df.join(renamed, _same(df, renamed, cols), "left").drop(*["_j_" + c for c in cols])


def large_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of more than ``LARGE`` rows (stored, at most one per ``LARGE`` rows of the table), None if there are none."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select(*keys)
    many = cut_lineage(many, "large")
    return None if many.isEmpty() else many


def cut_keys(df: DataFrame, keys: list[str], large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of other keys than the ``large`` ones, and those of the large ones (None if there are none)."""
    if large is None:
        return df, None
    marked = large.select(*[F.col(c).alias("_j_" + c) for c in keys])
    return tuple(df.join(marked, _same(df, marked, keys), how) for how in ("left_anti", "left_semi"))


def _earlier(kind: str, c: Column, w) -> Column:
    if kind == "sum":
        return F.sum(c).over(w)
    if kind == "max":
        return F.max(c).over(w)
    return F.last(c, ignorenulls=True).over(w)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    blocks: list[Column] | None = None,
    *,
    row_number: str | None = None,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    last_known: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
    large: DataFrame | bool | None = True,
) -> DataFrame:
    """Add running columns over ``keys`` in the total order ``order``.

    ``row_number``: 1..n. ``sums``: sum over the rows before this one (0 on the first row).
    ``previous``: value of the row before. ``last_known``: last non-null value up to this row.
    ``max_before``: maximum over the rows before.

    ``blocks`` are expressions that do not decrease along ``order`` (compared as a tuple), each
    tuple holding a task-sized share of a key. They default to steps of 65536 of ``order[0]``;
    give further ones when the first order column repeats. The carry then sorts one row per
    block of a key, some hundred thousand for a key of 10^11 rows.

    ``large`` are the keys to cut, as :func:`large_keys` found them (None: there are none) in this table or one
    that has no fewer rows of any key; True looks for them, which reads the input once more. Without ``keys`` the table is cut.
    """
    if keys and large is True:
        large = large_keys(df, keys)
    if keys and large is not None:
        kw = dict(row_number=row_number, sums=sums, previous=previous, last_known=last_known, max_before=max_before)
        small, many = cut_keys(df, keys, large)
        return ordered_scan(small, keys, order, large=None, **kw).unionByName(_cut_scan(many, keys, order, blocks, **kw))
    return _cut_scan(df, keys, order, blocks, whole=bool(keys), row_number=row_number, sums=sums, previous=previous, last_known=last_known, max_before=max_before)


def _cut_scan(df, keys, order, blocks, *, row_number, sums, previous, last_known, max_before, whole=False) -> DataFrame:
    """The scan of keys cut into blocks, or of ``whole`` keys in one window each."""
    sums, previous = sums or {}, previous or {}
    last_known, max_before = last_known or {}, max_before or {}
    if blocks is None:
        blocks = by_width(F.col(order[0]), 65536)
    if whole:
        blocks = []
    names = [f"_b{i}" for i in range(len(blocks))]
    # named inputs, so that the summary and the rows read the same expressions
    inputs, kinds, summary = {}, {}, []
    at = F.struct(*order)
    if row_number:
        kinds["rn"] = "sum"
        summary.append(F.count(F.lit(1)).alias("_s_rn"))
    for n, c in sums.items():
        inputs["_i_" + n], kinds[n] = c, "sum"
        summary.append(F.sum("_i_" + n).alias("_s_" + n))
    for n, c in previous.items():
        # wrapped, so that a null value still counts as the row before
        inputs["_i_" + n], kinds[n] = F.struct(c.alias("v")), "last"
        summary.append(F.max_by("_i_" + n, at).alias("_s_" + n))
    for n, c in last_known.items():
        inputs["_i_" + n], kinds[n] = c, "last"
        summary.append(F.max_by("_i_" + n, F.when(F.col("_i_" + n).isNotNull(), at)).alias("_s_" + n))
    for n, c in max_before.items():
        inputs["_i_" + n], kinds[n] = c, "max"
        summary.append(F.max("_i_" + n).alias("_s_" + n))

    cols = df.columns
    d = df.select(
        "*", *[b.alias(n) for b, n in zip(blocks, names)], *[c.alias(n) for n, c in inputs.items()]
    )
    w = Window.partitionBy(*keys, *names).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = []
    if row_number:
        local.append(F.row_number().over(w).alias("_l_rn"))
    local += [F.sum("_i_" + n).over(before).alias("_l_" + n) for n in sums]
    local += [F.lag("_i_" + n).over(w).alias("_l_" + n) for n in previous]
    local += [F.last("_i_" + n, ignorenulls=True).over(upto).alias("_l_" + n) for n in last_known]
    local += [F.max("_i_" + n).over(before).alias("_l_" + n) for n in max_before]
    rows = d.select(*cols, *names, *[c for c in inputs], *local)
    if whole:  # no block comes before
        d = rows.withColumns({"_c_" + n: F.lit(None).cast(rows.schema["_l_" + n].dataType) for n in kinds})
    else:
        ahead = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        carry = d.groupBy(*keys, *names).agg(*summary).select(
            *keys, *names, *[_earlier(k, F.col("_s_" + n), ahead).alias("_c_" + n) for n, k in kinds.items()]
        )
        d = _attach(rows, carry, keys + names)
    out = []
    if row_number:
        out.append((F.col("_l_rn") + F.coalesce(F.col("_c_rn"), F.lit(0))).cast("bigint").alias(row_number))
    for n in sums:
        zero = F.lit(0).cast(d.schema["_l_" + n].dataType)
        out.append((F.coalesce("_l_" + n, zero) + F.coalesce("_c_" + n, zero)).alias(n))
    for n in previous:
        out.append(F.coalesce("_l_" + n, "_c_" + n)["v"].alias(n))
    for n in last_known:
        out.append(F.coalesce("_l_" + n, "_c_" + n).alias(n))
    for n in max_before:
        out.append(F.greatest("_l_" + n, "_c_" + n).alias(n))
    return d.select(*cols, *out)


def numbered(df, keys, order, out="rn", blocks=None, large=True) -> DataFrame:
    """Dense 1..n per key in a total order."""
    return ordered_scan(df, keys, order, blocks, row_number=out, large=large)


def table_order(df: DataFrame, lead: str, rest: list[str], out: str, blocks: list[Column] | None = None, step: int = 1 << 20) -> DataFrame:
    """Dense 1..n over the whole table by (lead, rest): rows of smaller leads plus the place within
    the own lead. Only the counts per lead are summed over the table, in steps of ``step`` leads;
    the rows of one lead are cut by ``blocks``, so neither many leads nor a hot one meet in a task."""
    counts = df.groupBy(lead).agg(F.count(F.lit(1)).alias("_n"))
    ahead = ordered_scan(counts, [], [lead], by_width(F.col(lead), step), sums={"_ahead": F.col("_n")}).drop("_n")
    inner = numbered(df, [lead], rest, "_rn", blocks)
    return inner.join(ahead, lead).select(*df.columns, (F.col("_ahead") + F.col("_rn")).cast("bigint").alias(out))
