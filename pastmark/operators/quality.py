"""Quality rules: rows that break a rule become issues, with an id, a severity and the value; nothing is repaired."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def singletons(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once. Counted by key first, so a hot key is summed on the map side."""
    once = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, list(keys), "left_semi")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def promoted(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per key with the attributes all its rows agree on; keys that disagree are left out."""
    return _spread(df, keys, attributes).where(" and ".join(f"min_{a} <=> max_{a}" for a in attributes)).select(*keys, *(F.col(f"max_{a}").alias(a) for a in attributes))


def conflicts(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """(keys, attribute, lowest, highest) where rows of a key disagree."""
    long = [F.struct(F.lit(a).alias("attribute"), F.col(f"min_{a}").cast("string").alias("lowest"), F.col(f"max_{a}").cast("string").alias("highest")) for a in attributes]
    out = _spread(df, keys, attributes).select(*keys, F.explode(F.array(*long)).alias("x")).select(*keys, "x.*")
    return out.where("lowest <> highest")


def _spread(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Least and greatest of every attribute by key: equal if and only if it has one value; sums on the map side."""
    return df.groupBy(*keys).agg(*(f(a).alias(f"{n}_{a}") for a in attributes for n, f in (("min", F.min), ("max", F.max))))


def issues(broken: DataFrame, rule: str, severity: str, key: Column, value: Column) -> DataFrame:
    """(issue_id, rule, severity, issue_key, issue_value) for each row of `broken`."""
    key = key.cast("string")
    return broken.select(F.md5(F.concat_ws("|", F.lit(rule), key)).alias("issue_id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.alias("issue_key"), value.cast("string").alias("issue_value"))


def sourced_issues(broken: DataFrame, rule: str, severity: str, source: str, message: str, row_id: Column, key: Column, value: Column) -> DataFrame:
    """Issues with the table they come from, the row (NULL for groups of rows) and what is wrong."""
    key = key.cast("string")
    out = [F.md5(F.concat_ws("|", F.lit(rule), F.coalesce(row_id, key))).alias("issue_id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(source).alias("source"), row_id.alias("row_id"), key.alias("issue_key"), value.cast("string").alias("issue_value"), F.lit(message).alias("message")]
    return broken.select(*out)


def issue_table(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_counts(df: DataFrame, rules: Mapping[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """One row of counts of the rows breaking each rule (NULL does not break), in one pass."""
    return df.groupBy(*group).agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both, only left, only right, and the shares of each side that the other has."""
    left, right = a.select(*keys).distinct().withColumn("__a", F.lit(1)), b.select(*keys).distinct().withColumn("__b", F.lit(1))
    counts = left.join(right, list(keys), "full").agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"),
        F.count_if(F.col("__b").isNull()).alias("only_left"),
        F.count_if(F.col("__a").isNull()).alias("only_right"),
    )
    rate = lambda other: F.col("shared") / F.nullif(F.col("shared") + F.col(other), F.lit(0))
    return counts.withColumn("left_rate", rate("only_left")).withColumn("right_rate", rate("only_right"))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, compared, equal): NULL-safe agreement of two sources by key, one row per field."""
    both = a.select(*keys, *(F.col(f).alias(f"a_{f}") for f in fields)).join(b.select(*keys, *(F.col(f).alias(f"b_{f}") for f in fields)), list(keys))
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")).alias("same")) for f in fields))).alias("x"))
    return rows.groupBy("x.field").agg(F.count("*").alias("compared"), F.count_if("x.same").alias("equal"))


def sequence_gaps(df: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Groups whose positions are not 1 .. n, each once."""
    out = df.groupBy(*group).agg(F.count("*").alias("n_rows"), F.countDistinct(position).alias("n_places"), F.min(position).alias("first"), F.max(position).alias("last"))
    return out.where("n_rows <> n_places or first <> 1 or last <> n_rows")


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of every group in a total order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")
