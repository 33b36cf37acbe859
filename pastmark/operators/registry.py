"""A registry of columns as a table, and the audits derived from it: schema, values and forbidden columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registered:
    """A column: its type and role (key, lineage, feature, label, or forbidden: known too late to be in the table), the
    least and greatest value, whether it can be NULL, a column that it is never greater than, a count that is above 0
    exactly where it has a value, a column without which it has none, and the only value it can have."""

    name: str
    type: str
    role: str = "feature"
    low: float | None = None
    high: float | None = None
    nullable: bool = True
    at_most: str | None = None
    present_with: str | None = None
    only_with: str | None = None
    fixed: str | None = None


SCHEMA = "name string, type string, role string, low double, high double, nullable boolean, at_most string, present_with string, only_with string, fixed string"


def registry_table(spark: SparkSession, registry: Sequence[Registered]) -> DataFrame:
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame([astuple(replace(r, low=number(r.low), high=number(r.high))) for r in registry], SCHEMA)


def value_rules(registry: Sequence[Registered]) -> dict[str, Column]:
    """Rule -> rows that break it. NULLs break only the rules about NULL."""
    rules: dict[str, Column] = {}
    for r in registry:
        c = F.col(r.name)
        if r.role == "forbidden":
            continue
        if not r.nullable:
            rules[f"{r.name}:null"] = c.isNull()
        if r.low is not None or r.high is not None:
            out = F.lit(False)
            out = out if r.low is None else out | (c < r.low)
            rules[f"{r.name}:range"] = out if r.high is None else out | (c > r.high)
        if r.at_most:
            rules[f"{r.name}:at_most"] = c > F.col(r.at_most)
        if r.present_with:
            rules[f"{r.name}:present"] = c.isNotNull() != (F.coalesce(F.col(r.present_with).cast("double"), F.lit(0.0)) > 0)
        if r.only_with:
            rules[f"{r.name}:only_with"] = c.isNotNull() & F.col(r.only_with).isNull()
        if r.fixed is not None:
            rules[f"{r.name}:fixed"] = ~c.cast("string").eqNullSafe(F.lit(r.fixed))
    return rules


def schema_faults(df: DataFrame, registry: Sequence[Registered]) -> DataFrame:
    """(rule, n_broken): registered columns that are missing, of another type, forbidden ones that are there, and columns
    that are not registered."""
    spark, has = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    actual = spark.createDataFrame(list(has.items()), "name string, actual string")
    both = registry_table(spark, registry).join(actual, "name", "full")
    known, there = F.col("role").isNotNull(), F.col("actual").isNotNull()
    forbidden = F.coalesce(F.col("role") == "forbidden", F.lit(False))
    counts = both.agg(F.count_if(known & ~forbidden & ~there).alias("schema:missing"), F.count_if(known & ~forbidden & there & (F.col("type") != F.col("actual"))).alias("schema:type"), F.count_if(forbidden & there).alias("schema:forbidden"), F.count_if(~known).alias("schema:unregistered"))
    return counts.unpivot([], counts.columns, "rule", "n_broken")


def audit(df: DataFrame, registry: Sequence[Registered], more: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n_broken) of all rules of the registry and of `more`, rows counted in one aggregate; rules on columns that
    are missing or of another type cannot be counted and are left to the rules of the schema."""
    has = {f.name: f.dataType.simpleString() for f in df.schema}
    sound = [r for r in registry if has.get(r.name) == r.type and all(x is None or x in has for x in (r.at_most, r.present_with, r.only_with))]
    rules = value_rules(sound) | (more or {})
    counts = df.agg(*(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return counts.unpivot([], counts.columns, "rule", "n_broken").unionByName(schema_faults(df, registry))
