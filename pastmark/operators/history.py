"""Point-in-time history: what was known of an entity before a day.

Nothing here joins events with their past. Events are first summed by entity and day, so a hot entity is at most one
row per day; a running window over days that ends on the day before gives the prefix of each day; events take it by an
equi-join. The last N events before a day are arrays of N by entity and day, joined by windows over days. All frames
end before the current day, so events of the same day never see each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Measures = Mapping[str, tuple[str, Column]]
COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def prefix_by_day(events: DataFrame, keys: Sequence[str], day: str, measures: Measures) -> DataFrame:
    """(keys, day, measures): each measure (sum, min or max of a column) over earlier days; `n_prior`, events before."""
    of_day = events.groupBy(*keys, day).agg(F.count("*").alias("n_prior"), *(COMBINE[how](column).alias(name) for name, (how, column) in measures.items()))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    how = {"n_prior": "sum"} | {name: how for name, (how, _) in measures.items()}
    columns = [COMBINE[h](name).over(earlier).alias(name) for name, h in how.items()]
    return of_day.select(*keys, day, *columns).fillna(0, [n for n, h in how.items() if h == "sum"])


def prior_days(events: DataFrame, keys: Sequence[str], day: str, measures: Measures, last: tuple[int, Sequence[str], Sequence[str]] | None = None, latest: Mapping[str, int] | None = None) -> DataFrame:
    """(keys, day, n_prior, measures, last, latest_..): what `prefix_by_day` gives, and of the events of earlier days the
    last so many, as an array of structs with the latest first. `last`: (number, order within a day, values). `latest`:
    for each column how many of its last values that are not NULL, as `latest_<column>`, in the order of `last`.

    Rows are summed by entity and day before an entity's days meet, so of a day at most the events that count are kept,
    and one exchange by entity serves all windows."""
    latest = latest or {}
    known, kept = events.dropna(subset=[*keys, day]), []
    if last:
        n, tie, values = last
        of_day = Window.partitionBy(*keys, day).orderBy(*(F.desc(t) for t in tie))
        upto = of_day.rowsBetween(Window.unboundedPreceding, 0)
        known = known.select("*", F.row_number().over(of_day).alias("__r"), *(F.count(c).over(upto).alias(f"__c_{c}") for c in latest))
        in_order = lambda cond, value: F.array_sort(F.collect_list(F.when(cond, F.struct("__r", value.alias("v")))))["v"]
        kept = [in_order(F.col("__r") <= n, F.struct(*values)).alias("__own"), *(in_order(F.col(c).isNotNull() & (F.col(f"__c_{c}") <= m), F.col(c)).alias(f"__own_{c}") for c, m in latest.items())]
    days = known.groupBy(*keys, day).agg(F.count("*").alias("n_prior"), *(COMBINE[how](column).alias(name) for name, (how, column) in measures.items()), *kept)
    by = Window.partitionBy(*keys)
    earlier = by.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    how = {"n_prior": "sum"} | {name: how for name, (how, _) in measures.items()}
    columns = [COMBINE[h](name).over(earlier).alias(name) for name, h in how.items()]
    first = lambda lists, m: F.slice(F.flatten(F.reverse(lists)), 1, m)
    if last:
        columns.append(first(F.collect_list("__own").over(by.orderBy(day).rowsBetween(-n, -1)), n).alias("last"))
    # Days with a value of c are at even places, days after k of them at 2 k + 1: m days back are 2 m places back.
    place = lambda c: 2 * F.count_if(F.size(f"__own_{c}") > 0).over(by.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)) + (F.size(f"__own_{c}") == 0).cast("int")
    columns += [x for c in latest for x in (place(c).alias(f"__at_{c}"), F.when(F.size(f"__own_{c}") > 0, F.col(f"__own_{c}")).alias(f"__own_{c}"))]
    out = days.select(*keys, day, *columns).fillna(0, [name for name, h in how.items() if h == "sum"])
    for c, m in latest.items():
        out = out.withColumn(f"latest_{c}", first(F.collect_list(f"__own_{c}").over(by.orderBy(f"__at_{c}").rangeBetween(-2 * m, -1)), m))
    return out.drop(*(f"{x}_{c}" for c in latest for x in ("__at", "__own")))


def with_days(rows: DataFrame, days: DataFrame, keys: Sequence[str], day: str, at: Sequence[str]) -> DataFrame:
    """`rows`, dealt by `at` (some of the keys, and the day), with what is known by keys and day: only `days` move."""
    return rows.join(days.repartition(*at), [*keys, day], "left")


def with_prior(events: DataFrame, keys: Sequence[str], day: str, measures: Measures) -> DataFrame:
    """Events with the measures over their entity's earlier days. Events with a NULL key have NULL measures."""
    return events.join(prefix_by_day(events.dropna(subset=[*keys, day]), keys, day, measures), [*keys, day], "left")


def last_n_sums(events: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str], ids: Sequence[str], n: int, sums: Mapping[str, Column]) -> DataFrame:
    """(ids, last_n_count, sums) over the last n events of earlier days, from two running sums: no row is repeated."""
    measures = {name: ("sum", column) for name, column in sums.items()}
    both = with_prior(events.dropna(subset=[*keys, day]), keys, day, measures)
    day_order = Window.partitionBy(*keys, day).orderBy(*tie)
    run = both.withColumn("seq", F.col("n_prior") + F.row_number().over(day_order))
    running = run.select(*keys, "seq", *((F.col(name) + F.sum(column).over(day_order.rowsBetween(Window.unboundedPreceding, 0))).alias(f"before_{name}") for name, column in sums.items()))
    at = run.withColumn("at", F.col("n_prior") - n)
    cut = running.withColumnRenamed("seq", "at")
    joined = at.join(cut, [*keys, "at"], "left")
    return joined.select(*ids, F.least(F.col("n_prior"), F.lit(n)).alias("last_n_count"), *((F.col(name) - F.coalesce(F.col(f"before_{name}"), F.lit(0))).alias(name) for name in sums))


def lookback_counts(asked: DataFrame, events: DataFrame, keys: Sequence[str], day: str, days: int, ids: Sequence[str]) -> DataFrame:
    """(ids, n_before, n_until): events in the `days` days before a given day, without and with the day itself.

    Events and questions are put on one line per entity and counted by running sums over days."""
    count = events.groupBy(*keys, day).agg(F.count("*").alias("c"))
    ask = asked.select(*keys, day).distinct()
    line = count.unionByName(ask.withColumn("c", F.lit(0).cast("long"))).groupBy(*keys, day).agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    before = F.coalesce(F.sum("c").over(order.rangeBetween(-days, -1)), F.lit(0)).alias("n_before")
    until = F.sum("c").over(order.rangeBetween(-days, 0)).alias("n_until")
    return asked.select(*ids, *keys, day).join(line.select(*keys, day, before, until), [*keys, day]).select(*ids, "n_before", "n_until")
