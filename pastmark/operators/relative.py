"""A value's place among the values of its group, by windows over the group's columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastmark.operators.state import saved, small


def average_rank(x: str, group: Sequence[str], ascending: bool = True) -> Column:
    """Rank from 1; ties share the mean of their ranks. NULL values come last and move no one."""
    order = F.col(x).asc_nulls_last() if ascending else F.col(x).desc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, x))
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (ties - 1) / 2.0


def percentile_in_group(x: str, group: Sequence[str], higher_is_better: bool = True, least: int = 3) -> Column:
    """Average-tie percentile from 0 (worst) to 1 (best); NULL for a NULL value or fewer than `least` values."""
    n = F.count(x).over(Window.partitionBy(*group))
    return F.when(F.col(x).isNotNull() & (n >= least), (average_rank(x, group, higher_is_better) - 1) / (n - 1))


def gap_to_median(x: str, group: Sequence[str]) -> Column:
    return F.col(x) - F.median(F.col(x)).over(Window.partitionBy(*group))


def rank_percent_bin(x: str, group: Sequence[str], k: int) -> Column:
    """1 .. k by rank share, ties together; NULL for NULL values and where all values of the group are equal. For groups
    that one task can sort; `with_rank_bins` is for any."""
    whole = Window.partitionBy(*group)
    share = average_rank(x, group) / F.count(x).over(whole)
    flat = F.min(x).over(whole) == F.max(x).over(whole)
    return F.when(F.col(x).isNotNull() & ~flat, F.least(F.ceil(share * k), F.lit(k)).cast("int"))


def equal_count_bin(order: Sequence[str], group: Sequence[str], q: int) -> Column:
    """1 .. q over the sorted rows of a group, cut at equal positions as a quantile cut of 0 .. n - 1 does. For groups
    that one task can sort; `with_equal_bins` is for any."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return F.greatest(F.lit(1), F.ceil(at * F.lit(q) / F.greatest(n - 1, F.lit(1)))).cast("int")


def with_rank_bins(df: DataFrame, x: str, group: Sequence[str], k: int, flat: bool = True) -> DataFrame:
    """`df` with `bin`, as `rank_percent_bin` gives it; without `flat` also where all values are equal.

    Values are counted first; distinct values are dealt to ranges by quantiles of their group that the data give, and
    numbered by sums over ranges, so neither a large group nor a hot value is in one task."""
    at = numbered_values(df.where(F.col(x).isNotNull()), x, group)
    share = (F.col("__below") + (F.col("__n") + 1) / 2.0) / F.col("__all")
    varied = F.lit(True) if not flat else F.col("__n") < F.col("__all")
    bins = at.select(*group, F.col(x).alias("__x"), F.when(varied, F.least(F.ceil(share * k), F.lit(k)).cast("int")).alias("bin"))
    on = [df[g].eqNullSafe(bins[g]) for g in group]
    return df.join(bins, [*on, df[x] == bins["__x"]], "left").select(*(df[c] for c in df.columns), bins["bin"])


def with_equal_bins(df: DataFrame, order: Sequence[str], group: Sequence[str], q: int) -> DataFrame:
    """`df` with `bin`, 1 .. q, as `equal_count_bin` gives it, with rows numbered by ranges of their order."""
    at = numbered_values(df.withColumn("__o", F.struct(*order)), "__o", group)
    bins = at.select(*(F.col(g).alias(f"__b{i}") for i, g in enumerate(group)), "__o", F.greatest(F.lit(1), F.ceil(F.col("__below") * F.lit(q) / F.greatest(F.col("__all") - 1, F.lit(1)))).cast("int").alias("bin"))
    on = [F.col(g).eqNullSafe(F.col(f"__b{i}")) for i, g in enumerate(group)]
    return df.withColumn("__x", F.struct(*order)).join(bins, [*on, F.col("__x") == F.col("__o")]).select(*df.columns, "bin")


def numbered_values(df: DataFrame, x: str, group: Sequence[str], weights: Sequence[str] = ()) -> DataFrame:
    """(group, x, __n, __below, __all, and for each weight its sum of the value and of smaller values): one row per
    distinct value, with how many rows have it, have smaller ones and are in the group.

    Values are sorted by Spark's range partitioning; running sums inside a partition start from the sums of the
    partitions before, of which there are few."""
    sums = [F.count("*").alias("__n"), *(F.sum(w).alias(w) for w in weights)]
    names = ["__n", *weights]
    counted = saved(df.groupBy(*group, x).agg(*sums).repartitionByRange(*group, x).withColumn("__p", F.spark_partition_id()))
    parts = counted.groupBy(*group, "__p").agg(*(F.sum(n).alias(n) for n in names))  # few rows: parts and groups
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = parts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__p").alias("__part"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in names), F.sum("__n").over(whole).alias("__all"))
    own = Window.partitionBy(*group, "__p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.select("*", *(F.coalesce(F.sum(n).over(own), F.lit(0)).alias(f"__own_{n}") for n in names))
    on = [F.col("__p") == F.col("__part"), *(F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group))]
    out = rows.join(offsets, on)
    below = {n: (F.col(f"__own_{n}") + F.col(f"__before_{n}")).alias("__below" if n == "__n" else f"{n}_below") for n in names}
    return out.select(*group, x, *names, *below.values(), "__all")


#: Rank error of a quantile sketch, and how many times it a bracket reaches to both sides; values of a group up to which
#: its brackets are open.
SKETCH, REACH, LARGE = 1000, 3, 100_000


def exact_quantiles(df: DataFrame, x: str, group: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(group, q0, q1, ..): interpolated quantiles of the values that are neither NULL nor NaN, exact at every size.
    Groups without a value have no row.

    A sketch of each large group, merged from partial ones, brackets each quantile between two values close to its place;
    the brackets of other groups are open. One aggregate then counts what is below each bracket and how often the values
    inside occur; all other rows become one count, so a large group sends as many rows as there are distinct values
    within `2 * REACH / SKETCH` of it. The place is found among these by running sums."""
    rows = df.select(*group, F.col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    low, high = ([q + side * REACH / SKETCH for q in at] for side in (-1, 1))
    inside_of = [min(max(p, 0.0), 1.0) for p in (*low, *high)]
    counts = saved(rows.groupBy(*group).agg(F.count("*").alias("__all")))
    renamed = lambda df: df.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), *(c for c in df.columns if c not in group))
    on = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)), F.lit(True))
    large = counts.where(F.col("__all") > LARGE)
    if large.isEmpty():
        bounds = counts.withColumn("__s", F.lit(None).cast("array<double>"))
    else:
        sketched = rows.join(small(renamed(large)), on).groupBy(*group).agg(F.first("__all").alias("__all"), F.percentile_approx("__x", inside_of, SKETCH).alias("__s"))
        bounds = saved(sketched.unionByName(counts.where(F.col("__all") <= LARGE), allowMissingColumns=True))
    bounds = small(renamed(bounds))
    infinite = lambda sign: F.lit(sign * float("inf"))
    # A bracket that reaches beyond the ends is open there, and so are those of groups that are not large.
    known = lambda i, end: F.when(F.col("__all") > LARGE, F.col("__s")[i]).otherwise(end)
    lo = [infinite(-1) if p <= 0 else known(i, infinite(-1)) for i, p in enumerate(low)]
    hi = [infinite(1) if p >= 1 else known(len(at) + i, infinite(1)) for i, p in enumerate(high)]
    near = reduce(lambda a, b: a | b, (F.col("__x").between(a, b) for a, b in zip(lo, hi, strict=True)))
    both = rows.join(bounds, on).withColumn("__v", F.when(near, F.col("__x")))
    below = [F.count_if(F.isnull("__v") & (F.col("__x") < a)).alias(f"__b{i}") for i, a in enumerate(lo)]
    # Counts only, so that Spark aggregates by hash; the brackets are joined again to what is left.
    counted = both.groupBy(*group, "__v").agg(F.count("*").alias("__n"), *below).join(bounds, on)
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    places = counted.select("*", F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))).over(upto), F.lit(0)).alias("__inside"))
    # Below a value of a bracket are those outside all brackets that are below this one, and smaller ones inside any.
    places = places.select("*", *((F.max(f"__b{i}").over(whole) + F.col("__inside")).alias(f"__r{i}") for i in range(len(at))))
    place = lambda q: (F.col("__all") - 1) * F.lit(float(q))

    def value(i: int, k: Column) -> Column:
        at_rank = F.col("__v").between(lo[i], hi[i]) & (F.col(f"__r{i}") <= k) & (k < F.col(f"__r{i}") + F.col("__n"))
        return F.max(F.when(at_rank, F.col("__v")))

    parts = [(i, f(place(q))) for i, q in enumerate(at) for f in (F.floor, F.ceil)]
    found = places.groupBy(*group).agg(F.first("__all").alias("__all"), *(value(i, k).alias(f"__v{j}") for j, (i, k) in enumerate(parts)))
    missed = lambda i: F.raise_error(F.lit(f"no value at the place of quantile {at[i]} inside its bracket"))
    of = lambda i, j: F.coalesce(F.col(f"__v{2 * i + j}"), missed(i).cast("double"))
    between = lambda i, q: of(i, 0) + (of(i, 1) - of(i, 0)) * (place(q) - F.floor(place(q)))
    return found.select(*group, *(between(i, q).alias(f"q{i}") for i, q in enumerate(at)))


def joined_quantiles(found: DataFrame, df: DataFrame, x: str, group: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """`found`, one row per group of `df`, with the named quantiles of its values."""
    q = exact_quantiles(df, x, group, list(at.values()))
    q = q.select(*(F.col(g).alias(f"__q{i}") for i, g in enumerate(group)), *(F.col(f"q{i}").alias(n) for i, n in enumerate(at)))
    on = [F.col(g).eqNullSafe(F.col(f"__q{i}")) for i, g in enumerate(group)]
    return found.join(q, on, "left").select(*found.columns, *at)
