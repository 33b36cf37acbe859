"""Points to intervals, of any number and length and with any overlaps, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Halvings of the whole line of points: as many levels of cells as a length has bits.
LEVELS = 40


def cells_of(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The cells (level, cell) that make up low .. high, both inclusive whole numbers: at most two of a level. A cell of
    level k is 2^k points long; each point of the interval is in one of its cells, no other point is in any."""
    end, out = high + 1, []
    for k in range(max(1, levels)):
        unit = F.lit(1 << k).cast("long")
        first, last = F.ceil(low / unit).cast("long") if k else low, F.floor(end / unit).cast("long") if k else end
        at = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.alias("cell"))
        out += [F.when((first < last) & (F.pmod(first, F.lit(2)) == 1), at(first)), F.when((first < last) & (F.pmod(last, F.lit(2)) == 1), at(last - 1))]
    return F.filter(F.array(*out), F.isnotnull)


def interval_join(points: DataFrame, point: Column, intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Every point with every interval that holds it, ends included: the columns of both, whose names must differ.

    `point`, `low` and `high` are whole numbers, such as days. Intervals are cut in cells of powers of two, points are
    repeated once for each level that some interval uses, and both meet by level and cell: a point meets an interval
    that holds it in one cell and all others in none. No row is compared with a row it does not belong to. NULL points,
    open ends and ends before beginnings meet nothing."""
    longest = intervals.agg(F.max(high.cast("long") - low.cast("long") + 1)).first()[0] or 0
    cut = intervals.withColumn("__cell", F.explode(cells_of(low.cast("long"), high.cast("long"), max(longest, 0).bit_length())))
    levels = [r[0] for r in cut.select("__cell.level").distinct().collect()]  # at most LEVELS
    cut = cut.select(*intervals.columns, F.col("__cell.level").alias("__level"), F.col("__cell.cell").alias("__at"))
    place = lambda k: F.struct(F.lit(k).alias("level"), F.floor(point.cast("long") / F.lit(1 << k)).cast("long").alias("cell"))
    if not levels:
        return points.join(cut, F.lit(False)).select(*points.columns, *intervals.columns)
    dealt = points.withColumn("__place", F.explode(F.array(*map(place, sorted(levels)))))
    dealt = dealt.select(*points.columns, F.col("__place.level").alias("__level"), F.col("__place.cell").alias("__at"))
    return dealt.join(cut, ["__level", "__at"]).select(*points.columns, *intervals.columns)
