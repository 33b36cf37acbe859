"""Column expressions: safe parses, keys, dates, ratios, bands, probabilities. No Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column, unknown: str | None = None) -> Column:
    """Blank text is NULL; with `unknown`, NULL becomes that label."""
    out = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(out, F.lit(unknown)) if unknown is not None else out


def parse_int(c: Column) -> tuple[Column, Column]:
    """(decimal(38,0), valid) of a whole number in text; anything else is NULL and not valid."""
    value = F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("decimal(38,0)"))
    return value, value.isNotNull()


def parse_amount(c: Column) -> tuple[Column, Column]:
    """(decimal(20,0), valid) of a whole amount, thousands commas allowed; negative or broken amounts are not valid."""
    plain = F.regexp_replace(F.trim(c), ",", "")
    value = F.when(plain.rlike(r"^[0-9]+(\.0+)?$"), plain.try_cast("decimal(20,0)"))
    return value, value.isNotNull()


def parse_date(c: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def parse_seconds(c: Column) -> Column:
    """decimal(8,1); zero and broken text are NULL."""
    return F.nullif(F.trim(c).try_cast("decimal(8,1)"), F.lit(0).cast("decimal(8,1)"))


def parse_weight(c: Column) -> tuple[Column, Column]:
    """(kg, change) of `480(+3)`; an empty bracket is change 0, no bracket is change NULL, other text is NULL."""
    shape = r"^([0-9]+)(\(([+-]?[0-9]*)\))?$"
    ok, change = c.rlike(shape), F.regexp_extract(c, shape, 3)
    kg = F.when(ok, F.regexp_extract(c, shape, 1).try_cast("int"))
    inside = F.when(change == "", 0).otherwise(change.try_cast("int"))
    return kg, F.when(ok & (F.regexp_extract(c, shape, 2) != ""), inside)


def parse_track(c: Column) -> tuple[Column, Column]:
    """(label, percent) of `label (7%)`; the bracket may be missing."""
    label = blank_to_null(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
    return label, F.nullif(F.regexp_extract(c, r"\(\s*([0-9]+)\s*%\s*\)", 1), F.lit("")).try_cast("int")


def split_seconds(by_difference: Column, total: Column, passed: Column, direct: Column) -> Column:
    """A last split: total less the time passed where the venue gives that, else as it is given."""
    return F.when(by_difference, total - passed).otherwise(direct)


def mapping_label(by_difference: Column) -> Column:
    """Which way `split_seconds` has gone, for the lineage of a row."""
    return F.when(by_difference, "TOTAL_LESS_PASSED").otherwise("DIRECT")


def composite_key(*parts: Column, sep: str = "|") -> Column:
    """NULL if any part is NULL."""
    return reduce(lambda a, b: F.concat(a, F.lit(sep), b), parts)


def padded(c: Column, width: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def normalise(c: Column, labels: Mapping[str, Sequence[str]]) -> Column:
    """The label whose set holds the trimmed text; other text stays as it is."""
    text = F.trim(c)
    chain = reduce(lambda acc, kv: acc.when(text.isin(*kv[1]), kv[0]), list(labels.items())[1:], F.when(text.isin(*next(iter(labels.values()))), next(iter(labels))))
    return chain.otherwise(text)


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def date_parts(d: Column) -> dict[str, Column]:
    return {
        "date_key": F.date_format(d, "yyyyMMdd").cast("int"),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "month": F.month(d),
        "year_month": F.date_format(d, "yyyy-MM"),
        "month_start": F.trunc(d, "month"),
        "iso_weekday": F.weekday(d) + 1,
        "weekday_name": F.element_at(F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.weekday(d) + 1),
    }


def combinations(n: Column, picks: Column, ordered: Column) -> Column:
    """How many ways to pick 1, 2 or 3 of n, in order or not, as double; NULL for other numbers of picks."""
    n = n.cast("double")
    two, three = n * (n - 1), n * (n - 1) * (n - 2)
    return F.when(picks == 1, n).when((picks == 2) & ordered, two).when(picks == 2, two / 2).when((picks == 3) & ordered, three).when(picks == 3, three / 6)


def labelled_range(c: Column, ranges: Sequence[tuple[str, object, object]]) -> Column:
    """The first label whose closed range holds the value; NULL outside all."""
    return F.coalesce(*(F.when(c.between(F.lit(lo), F.lit(hi)), F.lit(label)) for label, lo, hi in ranges))


def band(n: Column, edges: Sequence[int]) -> Column:
    """`<=8`, `9-11`, `12+` for the edges 8, 11."""
    out = F.when(n <= edges[0], f"<={edges[0]}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(n <= hi, f"{lo + 1}-{hi}")
    return out.when(n > edges[-1], f"{edges[-1] + 1}+")


def probability_bin(p: Column, bins: int = 10) -> Column:
    """0 .. bins - 1, closed on the left; 1.0 and everything outside [0, 1) are NULL."""
    return F.when((p >= 0) & (p < 1), F.floor(p * bins).cast("int"))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column, eps: float = 1e-6) -> Column:
    return F.ln(clipped(p, eps) / (1 - clipped(p, eps)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def total(values: Column) -> Column:
    """The sum of an array of numbers; 0 of none."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """The mean of an array of numbers; NULL of none."""
    return ratio(total(values), F.size(values))


def sample_std(values: Column) -> Column:
    """The sample standard deviation of an array of numbers; NULL of fewer than two."""
    middle_, n = mean(values), F.size(values)
    return F.when(n > 1, F.sqrt(total(F.transform(values, lambda x: (x - middle_) * (x - middle_))) / (n - 1)))


def middle(values: Column) -> Column:
    """The median of an array, without NULL and NaN; NULL of none."""
    known = F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    at = lambda k: F.get(known, F.floor(k).cast("int"))
    return (at((F.size(known) - 1) / 2) + at(F.size(known) / 2)) / 2


def slope_to_latest(values: Column) -> Column:
    """The least-squares slope of an array of numbers, the latest first, per step towards the latest; NULL of fewer than
    two."""
    n = F.size(values).cast("double")
    weighed = total(F.transform(values, lambda v, i: -(i + 1) * v))
    sum_x, sum_xx = -n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    return (n * weighed - sum_x * total(values)) / F.nullif(n * sum_xx - sum_x * sum_x, F.lit(0.0))
