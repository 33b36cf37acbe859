"""Star-schema tables, summaries and market measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators.relative import joined_quantiles
from pastmark.operators.state import saved, small


def date_dimension(events: DataFrame, day: str) -> DataFrame:
    """One row per day from the first to the last, with its parts."""
    span = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select("day", *(c.alias(n) for n, c in C.date_parts(F.col("day")).items()))


def status_policy(rows: DataFrame, composite: DataFrame, single: DataFrame, keys: tuple[str, str], default: str) -> DataFrame:
    """A status for every row: by a rule on both codes, else by one on the first code, else the default.

    `composite`: both codes and status; `single`: first code and status. The rules are small seed tables."""
    a = composite.select(*keys, F.col("status").alias("__both"))
    b = single.select(keys[0], F.col("status").alias("__one"))
    out = rows.join(small(a), list(keys), "left").join(small(b), keys[0], "left")
    return out.withColumn("status", F.coalesce("__both", "__one", F.lit(default))).drop("__both", "__one")


def marked(rows: DataFrame, others: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """`rows` with a boolean: is there a row in `others` with the same keys? NULL keys find nothing."""
    found = others.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(found, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def run_log(output: DataFrame, version: str, inputs: Sequence[str], started_at, counts: Mapping[str, Column]) -> DataFrame:
    """One row on a finished run: version, inputs, status, times and counts of what it made, in one pass."""
    out = output.agg(*(c.alias(n) for n, c in counts.items()))
    return out.select(F.lit(version).alias("version"), F.lit(",".join(inputs)).alias("inputs"), F.lit("COMPLETED").alias("status"), F.lit(started_at).alias("started_at"), F.current_timestamp().alias("completed_at"), *counts)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], latest: str | None = None) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it does not have. A key that `new` repeats keeps the row of the greatest
    `latest`, and of rows that tie there the greatest in all columns; without `latest` repeats are an error."""
    if latest is None:
        again = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))))
        one = new.groupBy(*keys).agg(F.coalesce(again.cast("boolean"), F.lit(True)).alias("__once")).where("__once").drop("__once")
        fresh = new.join(one, list(keys), "left_semi")
    else:
        rest = [c for c in new.columns if c not in keys]
        fresh = new.groupBy(*keys).agg(F.max(F.struct(latest, *(c for c in rest if c != latest))).alias("__row")).select(*(c if c in keys else F.col(f"__row.{c}").alias(c) for c in new.columns))
    return fresh.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def eligible_groups(sales: DataFrame, group: Sequence[str], pool: str, n_pools: int) -> DataFrame:
    """(group, n_rows, n_pools, has_all, eligible): eligible with all pools, each in one row."""
    out = sales.groupBy(*group).agg(F.count("*").alias("n_rows"), F.countDistinct(pool).alias("n_pools"))
    return out.withColumn("has_all", F.col("n_pools") == n_pools).withColumn("eligible", (F.col("n_pools") == n_pools) & (F.col("n_rows") == n_pools))


def summary(df: DataFrame, dims: Sequence[str], amount: str, group: str, money: str = "decimal(18,2)") -> DataFrame:
    """(dims, n_groups, total, mean, median) of an amount; summed as decimals, so the order of rows is no matter."""
    total = F.sum(F.col(amount).cast(money)).cast("double")
    found = df.groupBy(*dims).agg(F.countDistinct(group).alias("n_groups"), total.alias("total"), (total / F.count(amount)).alias("mean"))
    return joined_quantiles(found, df, amount, dims, {"median": 0.5})


def group_total_summary(df: DataFrame, dims: Sequence[str], group: str, amount: str, money: str = "decimal(18,2)") -> DataFrame:
    """(dims, n_groups, mean_total, median_total): sums by group, then their mean and median by dimension."""
    sums = df.groupBy(*dims, group).agg(F.sum(F.col(amount).cast(money)).alias("x"))
    found = sums.groupBy(*dims).agg(F.count("*").alias("n_groups"), (F.sum("x").cast("double") / F.count("x")).alias("mean_total"))
    return joined_quantiles(found, sums, "x", dims, {"median_total": 0.5})


def share_of_total(df: DataFrame, dims: Sequence[str], amount: str, within: Sequence[str] = ()) -> DataFrame:
    """(dims, total, share of all or of `within`); the window runs over the sums only."""
    sums = df.groupBy(*dims).agg(F.sum(F.col(amount).cast("double")).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*within)))


def _places(members: DataFrame, group: str, rank: str) -> DataFrame:
    return members.groupBy(group).agg(*(F.count_if(F.col(rank) == k).alias(f"r{k}") for k in (1, 2, 3)))


def tied_counts(members: DataFrame, group: str, rank: str) -> DataFrame:
    """(group, pool, expected): how many combinations win in a pool by the members on ranks 1 to 3. With ties a rank is
    skipped: two first leave no second, and fill its place."""
    a, b, c = F.col("r1"), F.col("r2"), F.col("r3")
    two, placed = lambda n: (n * (n - 1) / 2).cast("long"), a + b + c
    expected = {
        "WIN": a, "QNL": F.when(b == 0, two(a)).otherwise(a * b), "EXA": F.when(b == 0, a * (a - 1)).otherwise(a * b), "QPL": two(placed),
        "TLA": F.when(b == 0, two(a) * c).when(c == 0, a * two(b)).otherwise(a * b * c), "TRI": F.when(b == 0, a * (a - 1) * c).when(c == 0, a * b * (b - 1)).otherwise(a * b * c),
    }
    return _places(members, group, rank).select(group, *(x.cast("long").alias(p) for p, x in expected.items())).unpivot(group, list(expected), "pool", "expected")


def winning_sets(members: DataFrame, group: str, rank: str) -> DataFrame:
    """(group, pool, paid): the same counts another way: every choice of ranks a combination can have, times the ways to
    fill it from the members on these ranks. The order of a combination is one of ranks that do not fall."""
    n = {k: F.col(f"r{k}") for k in (1, 2, 3)}

    def ways(ranks: tuple[int, ...], ordered: bool) -> Column:
        out = F.lit(1).cast("long")
        for k in set(ranks):
            m = ranks.count(k)
            for i in range(m):
                out = out * F.greatest(n[k] - i, F.lit(0))
            out = out if ordered or m < 2 else out / 2
        return out

    # A choice of ranks wins when no better rank is left open: the second place is of rank 2, or of rank 1 if two tied.
    none2, none3 = n[2] == 0, n[3] == 0
    pools = {
        "WIN": [((1,), F.lit(True))], "QNL": [((1, 2), F.lit(True)), ((1, 1), none2)], "EXA": [((1, 2), F.lit(True)), ((1, 1), none2)], "QPL": [((i, j), F.lit(True)) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j],
        "TLA": [((1, 2, 3), F.lit(True)), ((1, 1, 3), none2), ((1, 2, 2), none3)], "TRI": [((1, 2, 3), F.lit(True)), ((1, 1, 3), none2), ((1, 2, 2), none3)],
    }
    sums = {p: sum((F.when(cond, ways(ranks, p in ("EXA", "TRI"))).otherwise(0) for ranks, cond in choices), F.lit(0)) for p, choices in pools.items()}
    return _places(members, group, rank).select(group, *(x.cast("long").alias(p) for p, x in sums.items())).unpivot(group, list(sums), "pool", "paid")


#: Rows that are compared with each other in one place.
FRONT_ROWS = 4096


def pareto_front(metrics: DataFrame, key: str, more_is_better: Sequence[str], less_is_better: Sequence[str], block: int = FRONT_ROWS) -> DataFrame:
    """`metrics` with `on_front`: no other row is at least as good in all and better in one; rows with a NULL are on it.

    A row beaten anywhere is beaten by a row of its block's front or is not in the block's front itself, so fronts of
    blocks are found first, again and again while there is more than a block of them and they shrink; each row is then
    compared with what is left, block by block."""
    names = [*more_is_better, *less_is_better]
    signs = [1.0] * len(more_is_better) + [-1.0] * len(less_is_better)
    points = saved(metrics.select(F.col(key), *(F.col(c).cast("double").alias(c) for c in names)).dropna())

    def beaten(a, b):
        """Which rows of a some row of b beats."""
        import numpy as np

        out = np.zeros(len(a), bool)
        for x in b:
            out |= (x >= a).all(axis=1) & (x > a).any(axis=1)
        return out

    def front(frame):
        x = frame[names].to_numpy(float) * signs
        return frame[~beaten(x, x)]

    best, n = points, points.count()
    while n > block:
        dealt = best.withColumn("__b", F.pmod(F.xxhash64(*names, key), F.lit(-(-n // block))))
        fewer = saved(dealt.groupBy("__b").applyInPandas(front, dealt.schema).drop("__b"))
        before, n, best = n, fewer.count(), fewer
        if n > 0.9 * before:
            break
    blocks = max(1, -(-n // block))
    own = best.select(*names, F.pmod(F.xxhash64(*names), F.lit(blocks)).alias("__b"))
    asked = points.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(max(1, -(-points.count() // block)))))
    own = own.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-points.count() // block)) - 1))))

    def compare(_, a, b):
        return a[beaten(a[names].to_numpy(float) * signs, b[names].to_numpy(float) * signs)][[key]]

    schema = points.select(key).schema
    lost = asked.groupBy("__b", "__part").cogroup(own.groupBy("__b", "__part")).applyInPandas(compare, schema).distinct().withColumn("on_front", F.lit(False))
    return metrics.join(lost, key, "left").fillna(True, ["on_front"])


def rate_mix(df: DataFrame, segment: str, period: str, first: str, second: str, hit: Column) -> DataFrame:
    """One row: the rates of two periods, and the second's mix at the first's rates."""
    cells = df.where(F.col(period).isin(first, second)).groupBy(segment).agg(
        *(f.alias(f"{n}_{i}") for i, p in enumerate((first, second)) for n, f in (("n", F.count_if(F.col(period) == p)), ("hits", F.count_if((F.col(period) == p) & hit))))
    )
    rate = lambda i: F.sum(f"hits_{i}") / F.sum(f"n_{i}")
    expected = F.sum(F.col("n_1") * F.col("hits_0") / F.nullif(F.col("n_0"), F.lit(0))) / F.sum(F.when(F.col("n_0") > 0, F.col("n_1")))
    return cells.agg(rate(0).alias("first_rate"), rate(1).alias("second_rate"), expected.alias("second_mix_at_first_rates"))
