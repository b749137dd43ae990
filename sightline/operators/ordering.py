"""Exact order statistics, ranks and lookups that survive one huge group.

A window or an exact percentile over a hot group puts that whole group into one
task.  The operators here first put values into order-keeping buckets (of fixed
width for errors and scores, between data-driven splitters for ids), add up per bucket (map-side), and only then sort inside a bucket.  The
per-group window runs over bucket totals, whose number is bounded by the bucket
resolution and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sightline.functions.hashing import all_of

# Buckets per factor e, and the magnitude below which buckets become linear.
# 2**14 gives about 2.6e5 buckets per sign for values up to 1e4 px.
BUCKETS_PER_E = 1 << 14
LINEAR_BELOW = 1e-3
_BUCKET_LIMIT = float(1 << 53)

# Splitters of one column at most, the rows that a range between two of them is meant to hold, and the buckets
# into which the ranges are cut together.
MAX_SPLITTERS = 4095
ROWS_PER_BUCKET = 1 << 17
BUCKETS = 1 << 14

# Two hex digits of a token give 256 equal slices, three give 4096.
TOKEN_SLICE_DIGITS = 3
# Ways in which a group is cut for joins and top-n; see salted_join.
DEFAULT_SALTS = 16


def value_bucket(value: Column) -> Column:
    """Order-keeping bigint bucket of a double: equal values share a bucket.

    log1p is semi-monotonic by specification, so the bucket never decreases
    when the value grows.  Infinities go to the outermost buckets.
    """
    magnitude = F.log1p(F.abs(value) / F.lit(LINEAR_BELOW)) * F.lit(float(BUCKETS_PER_E))
    bounded = F.least(magnitude, F.lit(_BUCKET_LIMIT))
    return F.floor(F.when(value < 0, -bounded).otherwise(bounded)).cast("long")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which null keys match; keeps the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_right_{k}")
    on = all_of([left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join group facts onto rows so that one group is cut into ``salts`` parts.

    ``small`` has one row per group and is repeated per salt; ``big`` takes its
    salt from the hash of ``spread_by``.  Unlike a plain join on the group key
    this leaves no partitioning by the key alone, so a following aggregate by
    the key combines map-side and is exchanged again instead of running a hot
    group in one task.  Catalyst still broadcasts ``small`` when its measured
    size is below the session's threshold.
    """
    salted = big.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int"))
    repeated = small.withColumn(
        "_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_by: Sequence[str],
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """First ``n`` rows per group, cut twice.

    ``row_number() <= n`` is pushed below the exchange by Catalyst, and a first
    round per (group, salt) keeps the final task of a hot group at no more than
    ``salts * n`` rows.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final))
        .filter(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def _bucket_offsets(
    buckets: DataFrame, keys: Sequence[str], bucket: str, measures: Sequence[str]
) -> DataFrame:
    """Add ``before_<m>`` (sum over lower buckets) and ``total_<m>`` per group."""
    running = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    out = buckets
    for m in measures:
        out = out.withColumn(f"before_{m}", F.sum(m).over(running) - F.col(m)).withColumn(
            f"total_{m}", F.sum(m).over(whole))
    return out


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact zero-based row number per group, without one task per group.

    ``bucket`` must not decrease along ``order``.  Rows are numbered inside
    (group, bucket); the counts of lower buckets are added by an equi-join.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = _bucket_offsets(counts, keys, "_bucket", ["n"]).select(
        *keys, "_bucket", F.col("before_n").alias("_before"), F.col("total_n").alias("_total"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = join_null_safe(
        rows.withColumn("_inside", F.row_number().over(inside)), offsets, [*keys, "_bucket"], "inner")
    out = out.withColumn(rank, (F.col("_before") + F.col("_inside") - 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_bucket", "_inside", "_before", "_total")


def token_ranked(
    df: DataFrame,
    keys: Sequence[str],
    token: Column,
    ties: Sequence[str],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Position of each row in the seeded shuffle of its group."""
    rows = df.withColumn("_token", token)
    out = ranked(
        rows, keys, [F.col("_token"), *[F.col(t) for t in ties]],
        F.substring("_token", 1, TOKEN_SLICE_DIGITS), rank, total)
    return out.drop("_token")


def splitters(
    df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET, limit: int = MAX_SPLITTERS
) -> list:
    """The least value, values that cut ``df`` into ranges of about ``rows_per_bucket`` rows, and the greatest (runs a job).

    The cuts are quantiles of a mergeable sketch, so they follow the data: outlying values or gaps do not empty
    the other ranges.  At most ``limit`` values and the two ends reach the driver; a column without values has none.
    """
    kind = df.schema[value].dataType
    known = F.when(~F.isnan(value), F.col(value)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(value)
    probabilities = [i / (limit + 1) for i in range(1, limit + 1)]
    n, low, high, found = df.agg(
        F.count(known), F.min(known), F.max(known), F.percentile_approx(known, F.lit(probabilities), F.lit(4 * limit))).first()
    if not n:
        return []
    wanted = min(limit, n // rows_per_bucket)
    inner = {found[(i + 1) * (limit + 1) // (wanted + 1) - 1] for i in range(wanted)} - {low, high}
    return [low, *sorted(inner), high]


def splitter_bucket(value: Column, bounds: Sequence) -> Column:
    """Order-keeping bucket of a value: its range between :func:`splitters`, cut further into equal steps.

    The range is found by binary search.  The number of buckets is about :data:`BUCKETS` or the number of
    ranges, whichever is more; null is in the first, NaN in the last.
    """
    cuts = list(bounds[1:-1])
    steps = max(1, BUCKETS // (len(cuts) + 1))
    if not bounds:
        return F.lit(0).cast("long")
    held = F.array(*[F.lit(b) for b in bounds])
    leaps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    place = F.aggregate(
        F.array(*[F.lit(i) for i in leaps]), F.lit(0),
        lambda at, leap: F.when((at + leap <= len(cuts)) & (F.get(held, at + leap) <= value), at + leap).otherwise(at),
    ) if leaps else F.lit(0)
    ends = [F.get(held, place + i).cast("double") for i in (0, 1)]
    at = value.cast("double")
    inside = F.floor((at - ends[0]) / (ends[1] - ends[0]) * F.lit(float(steps)))
    # Ranges that reach infinity, or are one value, are not cut further.
    finite = (F.abs(ends[0]) < F.lit(float("inf"))) & (F.abs(ends[1]) < F.lit(float("inf"))) & (ends[1] > ends[0])
    step = F.when(value.isNull() | ~finite, F.lit(0)).when(F.isnan(at), F.lit(steps - 1)).otherwise(
        F.greatest(F.lit(0), F.least(inside, F.lit(steps - 1))))
    return place.cast("long") * F.lit(steps) + step


def value_ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Position by a mostly distinct numeric column (ids, sequence numbers).

    Rows are sorted inside buckets of :func:`splitters` of the whole column, counts of lower buckets are
    added per group.  The splitters are read by a job of their own; the ranks do not depend on them.
    """
    bounds = splitters(df, value, rows_per_bucket)
    return ranked(
        df, keys, [F.col(value), *[F.col(t) for t in ties]], splitter_bucket(F.col(value), bounds), rank, total)


def running_weight(
    df: DataFrame,
    weight: str,
    token: Column,
    ties: Sequence[str],
    before: str = "weight_before",
) -> DataFrame:
    """Cumulative weight before each row along the token order, over all rows."""
    rows = df.withColumn("_token", token).withColumn(
        "_bucket", F.substring("_token", 1, TOKEN_SLICE_DIGITS))
    sums = rows.groupBy("_bucket").agg(F.sum(weight).alias("w"))
    offsets = _bucket_offsets(sums, [], "_bucket", ["w"]).select(
        "_bucket", F.col("before_w").alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_token", *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_inside", F.sum(weight).over(inside) - F.col(weight))
        .join(offsets, "_bucket")
        .withColumn(before, F.col("_before") + F.col("_inside"))
        .drop("_token", "_bucket", "_inside", "_before")
    )


def _position(prob: float, count: Column) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and fraction of a linearly interpolated quantile."""
    at = F.lit(float(prob)) * (count - 1).cast("double")
    low = F.floor(at)
    return low, F.ceil(at), at - low


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    ``wanted`` maps an output column to (value column, probability).  Null and
    NaN values are left out; a group without values has no row.  Equal values
    are merged into one counted cell before anything is sorted, so neither a
    hot group nor a hot value meets in one task.
    """
    columns = sorted({column for column, _ in wanted.values()})
    entries = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(name).cast("double").alias("v"))
        for i, name in enumerate(columns)])
    long = (
        df.select(*keys, F.explode(entries).alias("_e"))
        .select(*keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    )
    cell_keys = [*keys, "_m", "_b"]
    cells = (
        long.withColumn("_b", value_bucket(F.col("_v")))
        .groupBy(*cell_keys, "_v").agg(F.count(F.lit(1)).alias("c"))
    )
    buckets = _bucket_offsets(
        cells.groupBy(*cell_keys).agg(F.sum("c").alias("c")), [*keys, "_m"], "_b", ["c"])

    def ranks_of(column: str, count: Column) -> list[Column]:
        found: list[Column] = []
        for source, prob in sorted(set(wanted.values())):
            if source == column:
                found.extend(_position(prob, count)[:2])
        return found

    first, past = F.col("before_c"), F.col("before_c") + F.col("c")
    # A CASE keeps Catalyst from pushing a condition on _m into one of the two
    # uses of the cells, so that both read the same exchange.
    needed = F.when(F.lit(False), F.lit(False))
    for i, column in enumerate(columns):
        covers = F.lit(False)
        for r in ranks_of(column, F.col("total_c")):
            covers = covers | ((r >= first) & (r < past))
        needed = needed.when(F.col("_m") == i, covers)
    chosen = buckets.filter(needed).select(
        *cell_keys, F.col("before_c").alias("_before"), F.col("total_c").alias("_n"))

    inside = Window.partitionBy(*cell_keys).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (
        join_null_safe(cells, chosen, cell_keys, "inner")
        .withColumn("_past", F.col("_before") + F.sum("c").over(inside))
        .withColumn("_first", F.col("_past") - F.col("c"))
    )

    aggregates = []
    for out, (column, prob) in wanted.items():
        low, high, _ = _position(prob, F.col("_n"))
        mine = F.col("_m") == columns.index(column)
        for tag, r in (("lo", low), ("hi", high)):
            aggregates.append(F.max(F.when(
                mine & (r >= F.col("_first")) & (r < F.col("_past")), F.col("_v"))
            ).alias(f"_{tag}_{out}"))
        aggregates.append(F.max(F.when(mine, F.col("_n"))).alias(f"_n_{out}"))
    picked = placed.groupBy(*keys).agg(*aggregates)

    results = []
    for out, (_, prob) in wanted.items():
        frac = _position(prob, F.col(f"_n_{out}"))[2]
        low, high = F.col(f"_lo_{out}"), F.col(f"_hi_{out}")
        results.append(
            F.when((low == high) | (frac == 0), low).otherwise(low + (high - low) * frac).alias(out))
    return picked.select(*keys, *results)


def exact_medians(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, str]) -> DataFrame:
    """Exact medians; ``wanted`` maps output column to value column."""
    return exact_quantiles(df, keys, {out: (column, 0.5) for out, column in wanted.items()})


def with_medians(
    summary: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, str]
) -> DataFrame:
    """Attach exact medians of ``df`` to a per-group summary of it."""
    medians = exact_medians(df, keys, wanted)
    if not keys:
        return attach_scalars(summary, medians)
    return join_null_safe(summary, medians, keys)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame through one scalar subquery (no join).

    The row travels as a struct: a subquery per column would plan and run the
    whole of ``one_row`` once per column.
    """
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one", packed).select(
        *df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as literals (runs a job returning that row).

    For facts about a whole table that every row of another needs: quartile
    edges, totals, offsets.  A literal keeps the following plans small and lets
    Catalyst fold and push it; an empty frame gives nulls.
    """
    row = one_row.limit(1).collect()
    values = row[0].asDict() if row else {}
    return df.select("*", *[
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in one_row.schema.fields])


def counted_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group: ``_v``, count ``c``, rows below ``start``, group ``total``."""
    cells = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, value_bucket(F.col("_v")).alias("_b"), "_v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    buckets = _bucket_offsets(
        cells.groupBy(*keys, "_b").agg(F.sum("c").alias("c")), keys, "_b", ["c"]
    ).select(*keys, "_b", F.col("before_c").alias("_before"), F.col("total_c").alias("total"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        join_null_safe(cells, buckets, [*keys, "_b"], "inner")
        .withColumn("start", F.col("_before") + F.sum("c").over(inside) - F.col("c"))
        .select(*keys, "_v", "c", "start", "total")
    )


def values_at_ranks(
    queries: DataFrame, rank: str, cells: DataFrame, out: str, chunk: int = 1 << 20
) -> DataFrame:
    """Value of the cell that covers each asked rank of one ordered population.

    Cells and queries meet in slices of ``chunk`` consecutive ranks and are
    merged in one sort; a cell that spans slices enters each of them.
    """
    size = F.lit(chunk)
    last = F.col("start") + F.col("c") - 1
    marks = cells.withColumn("_slice", F.explode(F.sequence(
        F.floor(F.col("start") / size), F.floor(last / size)))).select(
        "_slice", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("_v").alias("_value"),
        *[F.lit(None).cast(t).alias(c) for c, t in queries.dtypes])
    asked = queries.select(
        F.floor(F.col(rank) / size).alias("_slice"), F.col(rank).alias("_at"),
        F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_value"), *queries.columns)
    merged = Window.partitionBy("_slice").orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        marks.unionByName(asked)
        .withColumn(out, F.last("_value", ignorenulls=True).over(merged))
        .filter(F.col("_kind") == 1)
        .select(*queries.columns, out)
    )


def two_class_cells(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """Counts of both classes per distinct value, merged map-side."""
    return (
        df.withColumn("_v", F.col(value).cast("double"))
        .withColumn("_first_class", is_first)
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_first_class").isNotNull())
        .groupBy(*keys, value_bucket(F.col("_v")).alias("_b"), "_v")
        .agg(
            F.count_if(F.col("_first_class")).alias("n_first"),
            F.count_if(~F.col("_first_class")).alias("n_second"),
        )
    )


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """Average-rank sum of the first class, class sizes and tie term per group.

    Ranks are added up bucket by bucket: inside a bucket from its own cells,
    across buckets from totals, in one chain of exchanges and no join.
    """
    cells = two_class_cells(df, keys, value, is_first).withColumn(
        "t", F.col("n_first") + F.col("n_second"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tied = F.col("t").cast("double")
    local_rank = (F.sum("t").over(inside) - F.col("t")).cast("double") + (tied + 1) / 2
    per_bucket = (
        cells.withColumn("_r", local_rank)
        .groupBy(*keys, "_b")
        .agg(
            F.sum("n_first").alias("n_first"),
            F.sum("n_second").alias("n_second"),
            F.sum("t").alias("t"),
            F.sum(F.col("n_first") * F.col("_r")).alias("local_sum"),
            F.sum(tied * tied * tied - tied).alias("tie_term"),
        )
    )
    placed = _bucket_offsets(per_bucket, keys, "_b", ["t"])
    return placed.groupBy(*keys).agg(
        F.sum("n_first").alias("n_first"),
        F.sum("n_second").alias("n_second"),
        F.sum(F.col("local_sum") + F.col("n_first") * F.col("before_t").cast("double"))
        .alias("rank_sum"),
        F.sum("tie_term").alias("tie_term"),
    )


def class_counts_at_or_above(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Per distinct value ``_v``: rows of each class at or above it, and totals."""
    cells = two_class_cells(df, [], value, is_first)
    totals = ["n_first", "n_second"]
    buckets = _bucket_offsets(
        cells.groupBy("_b").agg(*[F.sum(c).alias(c) for c in totals]), [], "_b", totals
    ).select("_b", *[f"before_{c}" for c in totals], *[f"total_{c}" for c in totals])
    inside = Window.partitionBy("_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = cells.join(buckets, "_b")
    for name in ("first", "second"):
        below = F.col(f"before_n_{name}") + F.sum(f"n_{name}").over(inside) - F.col(f"n_{name}")
        out = out.withColumn(f"at_{name}", F.col(f"total_n_{name}") - below)
    return out.select(
        "_v", "at_first", "at_second",
        F.col("total_n_first").alias("total_first"), F.col("total_n_second").alias("total_second"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value: its count and its average rank (ties shared)."""
    cells = two_class_cells(df, keys, value, F.lit(True)).withColumnRenamed("n_first", "t")
    buckets = _bucket_offsets(
        cells.groupBy(*keys, "_b").agg(F.sum("t").alias("t")), keys, "_b", ["t"]
    ).select(*keys, "_b", F.col("before_t").alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        join_null_safe(cells, buckets, [*keys, "_b"], "inner")
        .withColumn(
            "average_rank",
            (F.col("_before") + F.sum("t").over(inside) - F.col("t")).cast("double")
            + (F.col("t").cast("double") + 1) / 2)
        .select(*keys, F.col("_v").alias(value), F.col("t").alias("n"), "average_rank")
    )

