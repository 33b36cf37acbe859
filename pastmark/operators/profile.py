"""Profiles: all columns in one pass, never one scan per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastmark.operators.relative import joined_quantiles


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_null, n_blank, n_distinct, n_zero), one row per column."""
    text = {c: F.col(c).cast("string") for c in columns}
    wide = df.agg(
        F.count("*").alias("n_rows"),
        *(x for i, c in enumerate(columns) for x in (
            F.count_if(F.col(c).isNull()).alias(f"null_{i}"), F.count_if(F.trim(text[c]) == "").alias(f"blank_{i}"), F.countDistinct(c).alias(f"distinct_{i}"), F.count_if(F.coalesce(text[c].try_cast("double") == 0, F.lit(False))).alias(f"zero_{i}"))),
    )
    rows = [F.struct(F.lit(c).alias("column"), "n_rows", *(F.col(f"{n}_{i}").alias(f"n_{n}") for n in ("null", "blank", "distinct", "zero"))) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def field_types(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_rows, n_blank, n_integer, n_decimal, n_distinct) of text fields."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select("x.*")
    of = lambda shape: F.count_if(F.col("v").rlike(shape))
    return long.groupBy("field").agg(F.count("*").alias("n_rows"), F.count_if(F.trim("v") == "").alias("n_blank"), of(r"^[+-]?[0-9]+$").alias("n_integer"), of(r"^[+-]?[0-9]*\.[0-9]+$").alias("n_decimal"), F.countDistinct("v").alias("n_distinct"))


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str], drop_null: bool = True) -> DataFrame:
    """(ids, metric, value) of the columns as double."""
    out = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(ids), list(columns), "metric", "value")
    return out.where("value is not null") if drop_null else out


def availability(df: DataFrame, dims: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(dims, metric, n_rows, n_present): how much of each column is there, by dimension."""
    return long_form(df, dims, columns, False).groupBy(*dims, "metric").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_present"))


def rule_shares(df: DataFrame, dims: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(dims, rule, share) of rows that meet each rule."""
    wide = df.groupBy(*dims).agg(*(F.avg(rule.cast("int")).alias(name) for name, rule in rules.items()))
    return wide.unpivot(list(dims), list(rules), "rule", "share")


def quantile_profile(df: DataFrame, dims: Sequence[str], columns: Sequence[str], at: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(dims, metric, n_rows, null_rate, mean, p10 ..): exact interpolated quantiles by dimension."""
    long, by = long_form(df, dims, columns, False), [*dims, "metric"]
    out = long.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(F.col("value").isNull().cast("int")).alias("null_rate"), F.avg("value").alias("mean"))
    return joined_quantiles(out, long, "value", by, {f"p{round(100 * p)}": p for p in at})


def composition(df: DataFrame, period: Sequence[str], dim: str) -> DataFrame:
    """(period, dim, n_rows, share of the period)."""
    n = df.groupBy(*period, dim).agg(F.count("*").alias("n_rows"))
    return n.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*period)))


def equal_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(left, right): columns with the same values in all rows; hashes propose pairs, a comparison confirms them."""
    hashes = df.agg(*(F.sum(F.xxhash64(*key, F.coalesce(F.col(c).cast("string"), F.lit("\0"))).cast("decimal(38,0)")).alias(c) for c in columns)).first()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if hashes[a] == hashes[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string")
    wide = df.agg(*(F.count_if(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"d{i}").alias("differ")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).where("x.differ = 0").select("x.left", "x.right")


def key_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct rows, distinct keys, keys that occur more than once."""
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct_rows"))
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"))
    return rows.crossJoin(by_key)  # one row each
