"""Ordered computations that stay parallel when one group holds most of the rows.

A window sorts each group inside one task. Here a large group is first cut into
consecutive slices: a hash sample of about one row in `rows_per_slice` supplies the cut
points, windows run per (group, slice), and a small table of slice totals carries the
running values across the cuts. The sample only decides where to cut, so every result is
exact and no row is dropped; groups without enough sampled rows stay whole and pay nothing.

Broadcast sizes: cut points and slice totals hold about (rows of large groups) /
`rows_per_slice` entries, i.e. some tens of MB for 10^12 rows at the default. The number of
slices follows from the parameter, not from the number of groups.

Order columns are ascending with NULLs last, and should end in a unique key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
MIN_CUTS = 4
SEARCH_STEPS = 24  # binary search over up to 2^24 cut points

_CUTS, _SLICE, _AT, _CUT = "__cuts", "__slice", "__at", "__cut"


def sort_key(order: Sequence[str]) -> Column:
    """Comparable struct: ascending, NULLs last."""
    parts = []
    for i, name in enumerate(order):
        parts += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def _same_keys(left: DataFrame, right: DataFrame, names: Mapping[str, str]) -> Column:
    pairs = [left[a].eqNullSafe(right[b]) for a, b in names.items()]
    return reduce(lambda a, b: a & b, pairs)


def _sampled(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int) -> DataFrame:
    pick = F.pmod(F.xxhash64(*order, *keys), F.lit(rows_per_slice)) == 0
    return df.where(pick).select(*keys, sort_key(order).alias(_AT))


def _position(cuts: Column, at: Column) -> Column:
    """How many cut points are ≤ `at` (binary search)."""
    steps = F.array(*[F.lit(1 << s) for s in range(SEARCH_STEPS - 1, -1, -1)])

    def advance(pos: Column, step: Column) -> Column:
        reaches = (pos + step <= F.size(cuts)) & (F.get(cuts, pos + step - 1) <= at)
        return F.when(reaches, pos + step).otherwise(pos)

    return F.aggregate(steps, F.lit(0), advance)


def slice_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """`df` plus the slice number of each row (0 everywhere in groups that are not cut) and whether its group is cut.

    The cut points are dropped where the rows have found their slice, so no exchange carries them.
    """
    sample = _sampled(df, keys, order, rows_per_slice)
    if not keys:
        cuts = sample.agg(F.sort_array(F.collect_list(_AT)).alias(_CUTS)).scalar()
        whole = df.withColumn(_CUTS, cuts)
        return whole.withColumn(_SLICE, _position(F.col(_CUTS), sort_key(order))).withColumn(_CUT, F.lit(True)).drop(_CUTS)
    renamed = {k: f"__k{i}" for i, k in enumerate(keys)}
    large = (
        sample.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(_AT)).alias(_CUTS))
        .where(F.size(_CUTS) >= MIN_CUTS)
        .withColumnsRenamed(renamed)
    )
    joined = df.join(F.broadcast(large), _same_keys(df, large, renamed), "left").drop(*renamed.values())
    found = F.when(F.col(_CUTS).isNotNull(), _position(F.col(_CUTS), sort_key(order))).otherwise(0)
    return joined.withColumn(_SLICE, found).withColumn(_CUT, F.col(_CUTS).isNotNull()).drop(_CUTS)


def split_crowded(
    df: DataFrame, key: str, sampled: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary groups, and those of groups that a hash of `sampled` columns finds crowded (NULL keys are a group)."""
    crowded = (
        _sampled(df, [key], sampled, rows_per_slice)
        .groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= MIN_CUTS).select(F.col(key).alias("__crowded"))
    )
    same = df[key].eqNullSafe(crowded["__crowded"])
    return df.join(F.broadcast(crowded), same, "left_anti"), df.join(F.broadcast(crowded), same, "left_semi")


def _carried(
    sliced: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], carries: Mapping[str, Column]
) -> DataFrame:
    """Per slice of a cut group: values carried in from the slices before it.

    `totals` aggregates one slice; `carries` are window columns over those totals, one
    group of slices at a time. Only cut groups appear here, one row per slice.
    """
    cut_only = sliced.where(_CUT) if keys else sliced
    per_slice = cut_only.groupBy(*keys, _SLICE).agg(*[c.alias(n) for n, c in totals.items()])
    return per_slice.select(*keys, _SLICE, *[c.alias(n) for n, c in carries.items()])


def _attach(sliced: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = {k: f"__c{i}" for i, k in enumerate([*keys, _SLICE])}
    small = carried.withColumnsRenamed(renamed)
    return sliced.join(F.broadcast(small), _same_keys(sliced, small, renamed), "left").drop(*renamed.values())


def _slice_windows(keys: Sequence[str]):
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ordered = whole.orderBy(_SLICE)
    return whole, ordered, ordered.rowsBetween(Window.unboundedPreceding, -1)


def group_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rank: str = "rank",
    total: str | None = None,
    previous: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    keep_slices: bool = False,
) -> DataFrame:
    """1-based rank in the group, group size, LAG and FIRST values, as one sorted pass.

    `previous` / `first` map a source column to the name of its lagged / first value.
    """
    previous, first = dict(previous or {}), dict(first or {})
    sliced = slice_groups(df, keys, order, rows_per_slice)
    local = Window.partitionBy(*keys, _SLICE)
    by_order = local.orderBy(*ascending(order))

    totals = {"__n": F.count(F.lit(1))}
    for i, source in enumerate(previous):
        totals[f"__last{i}"] = F.max_by(source, sort_key(order))
    for i, source in enumerate(first):
        totals[f"__head{i}"] = F.min_by(source, sort_key(order))
    whole, ordered, before = _slice_windows(keys)
    carries = {
        "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        "__all": F.sum("__n").over(whole),
    }
    for i in range(len(previous)):
        carries[f"__prev{i}"] = F.lag(f"__last{i}").over(ordered)
    for i in range(len(first)):
        carries[f"__first{i}"] = F.first(f"__head{i}").over(ordered)
    carried = _carried(sliced, keys, totals, carries)

    out = sliced.withColumn("__rn", F.row_number().over(by_order))
    if total:
        out = out.withColumn("__here", F.count(F.lit(1)).over(local))
    for i, source in enumerate(previous):
        out = out.withColumn(f"__lag{i}", F.lag(source).over(by_order))
    for i, source in enumerate(first):
        out = out.withColumn(f"__top{i}", F.first(source).over(by_order))
    out = _attach(out, carried, keys)

    columns = {rank: (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("bigint")}
    if total:
        columns[total] = F.coalesce("__all", "__here")
    for i, name in enumerate(previous.values()):
        columns[name] = F.when(F.col("__rn") == 1, F.col(f"__prev{i}")).otherwise(F.col(f"__lag{i}"))
    for i, name in enumerate(first.values()):
        # a cut group always has carried values, so its first value may legitimately be NULL
        columns[name] = F.when(F.col("__all").isNotNull(), F.col(f"__first{i}")).otherwise(F.col(f"__top{i}"))
    kept = [*df.columns, *([_SLICE, _CUT] if keep_slices else [])]
    return out.select(*kept, *[c.alias(n) for n, c in columns.items()])


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    opens: Column,
    *,
    previous: Mapping[str, str],
    session: str = "session_id",
    session_rank: str = "session_order_rank",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Gap-and-island ids: running count of opening rows, and the rank inside each island.

    `opens` may use the lagged columns of `previous`; the first row of a group always opens.
    """
    ranked = group_sequence(
        df, keys, order, rank="__rank", previous=previous,
        rows_per_slice=rows_per_slice, keep_slices=True,
    ).withColumn("__opens", F.when((F.col("__rank") == 1) | F.coalesce(opens, F.lit(False)), 1).otherwise(0))
    starts = F.when(F.col("__opens") == 1, F.col("__rank"))

    _, _, before = _slice_windows(keys)
    carried = _carried(
        ranked, keys,
        {"__opened": F.sum("__opens"), "__latest": F.max(starts)},
        {"__ids": F.sum("__opened").over(before), "__start": F.max("__latest").over(before)},
    )
    running = (
        Window.partitionBy(*keys, _SLICE).orderBy("__rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = ranked.withColumn("__id", F.sum("__opens").over(running)).withColumn(
        "__since", F.max(starts).over(running)
    )
    out = _attach(out, carried, keys)
    return out.select(
        *df.columns,
        *previous.values(),
        (F.col("__id") + F.coalesce("__ids", F.lit(0))).cast("bigint").alias(session),
        (F.col("__rank") - F.coalesce("__since", "__start") + 1).cast("bigint").alias(session_rank),
    )


def global_prefix(
    df: DataFrame,
    order: Sequence[str],
    measures: Mapping[str, str | Column],
    *,
    totals: Mapping[str, str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exclusive prefix sums over the whole table in `order`, without one task seeing all rows.

    `measures` maps an output name to the summed column; `totals` maps a measure to the
    name of its grand total.
    """
    totals = dict(totals or {})
    sums = {f"__m{i}": F.col(m) if isinstance(m, str) else m for i, m in enumerate(measures.values())}
    names = list(measures)
    sliced = slice_groups(df.withColumns(sums), [], order, rows_per_slice)
    whole, _, before = _slice_windows([])
    carried = _carried(
        sliced, [],
        {m: F.sum(m) for m in sums},
        {
            **{f"{m}_in": F.sum(m).over(before) for m in sums},
            **{f"{m}_all": F.sum(m).over(whole) for m in sums},
        },
    )
    running = (
        Window.partitionBy(_SLICE).orderBy(*ascending(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = sliced
    for m in sums:
        out = out.withColumn(f"{m}_here", F.sum(m).over(running))
    out = _attach(out, carried, [])
    zero = F.lit(0)
    columns = [
        (F.coalesce(f"{m}_here", zero) + F.coalesce(f"{m}_in", zero)).alias(name)
        for m, name in zip(sums, names)
    ]
    grand = [F.col(f"__m{names.index(m)}_all").alias(alias) for m, alias in totals.items()]
    return out.select(*df.columns, *columns, *grand)


def distributed_ntile(
    df: DataFrame, order: Sequence[str], tiles: int, alias: str = "tile", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """NTILE(tiles) over the whole table: the first N mod T tiles get one row more."""
    placed = global_prefix(
        df, order, {"__r": F.lit(1).cast("bigint")}, totals={"__r": "__n"}, rows_per_slice=rows_per_slice
    )
    r, n, t = F.col("__r"), F.col("__n"), F.lit(tiles)
    base, extra = F.floor(n / t), n % t
    longer = extra * (base + 1)
    tile = F.when(r < longer, F.floor(r / (base + 1))).otherwise(
        extra + F.floor((r - longer) / F.greatest(base, F.lit(1)))
    )
    return placed.select(*df.columns, (tile + 1).cast("bigint").alias(alias))


def value_counts(df: DataFrame, value: str, arm: str) -> DataFrame:
    """Distinct values with their frequency in the arms 1 and 0 (NULL values are left out)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(
            F.sum(F.when(F.col(arm) == 1, 1).otherwise(0)).cast("bigint").alias("n1"),
            F.sum(F.when(F.col(arm) == 0, 1).otherwise(0)).cast("bigint").alias("n0"),
        )
    )


def ranked_values(counts: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Distinct values with cumulative counts, midranks of the pooled sample and grand totals."""
    cumulative = global_prefix(
        counts, ["value"], {"below1": "n1", "below0": "n0"},
        totals={"below1": "total1", "below0": "total0"}, rows_per_slice=rows_per_slice,
    )
    tied = F.col("n1") + F.col("n0")
    return cumulative.withColumn("midrank", F.col("below1") + F.col("below0") + (tied + 1) / 2.0)


def median_of_counts(value: str, count: str, below: str, total: str) -> Column:
    """Aggregate expression: median of a frequency table (mean of the middle two when even)."""
    holds_low = (F.col(below) <= F.floor((F.col(total) - 1) / 2)) & (
        F.floor((F.col(total) - 1) / 2) < F.col(below) + F.col(count)
    )
    holds_high = (F.col(below) <= F.floor(F.col(total) / 2)) & (
        F.floor(F.col(total) / 2) < F.col(below) + F.col(count)
    )
    low = F.max(F.when(holds_low, F.col(value)))
    high = F.max(F.when(holds_high, F.col(value)))
    return (low.cast("double") + high.cast("double")) / 2.0
