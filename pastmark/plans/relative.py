"""Values among the values of their group, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import history as H
from pastmark.operators import profile as P
from pastmark.operators import relative as R
from pastmark.operators.state import saved
from pastmark.plans.base import RUNS, Registry, rounded, runs, table


register = Registry()

RELATIVE = RUNS + """,
x AS (SELECT grp, member, d, CASE WHEN rating >= 5 THEN t END AS v, rating, weight FROM runs),
rel AS (SELECT grp, member, d, v, count(v) OVER g AS n, rank() OVER (PARTITION BY grp ORDER BY v NULLS LAST) AS lo, rank() OVER (PARTITION BY grp ORDER BY v DESC NULLS LAST) AS hi, count(*) OVER (PARTITION BY grp, v) AS ties, median(v) OVER g AS middle FROM x WINDOW g AS (PARTITION BY grp))
"""


def values(spark, sf_dir):
    return runs(spark, sf_dir).select("grp", "member", "d", F.when(F.col("rating") >= 5, F.col("t")).alias("v"), "rating", "weight")


def _pct(rank):
    return f"CASE WHEN v IS NOT NULL AND n >= 3 THEN round(({rank} + (ties - 1) / 2.0 - 1) / (n - 1), 8) END"


@register(f"WITH {RELATIVE} SELECT grp, member, {_pct('lo')} AS percentile FROM rel")
def field_percentile_high(spark, sf_dir):
    return values(spark, sf_dir).select("grp", "member", F.round(R.percentile_in_group("v", ["grp"]), 8).alias("percentile"))


@register(f"WITH {RELATIVE} SELECT grp, member, {_pct('hi')} AS percentile FROM rel")
def field_percentile_low(spark, sf_dir):
    return values(spark, sf_dir).select("grp", "member", F.round(R.percentile_in_group("v", ["grp"], False), 8).alias("percentile"))


@register(f"WITH {RELATIVE} SELECT grp, member, round(v - middle, 4) AS gap FROM rel")
def median_gap(spark, sf_dir):
    return values(spark, sf_dir).select("grp", "member", F.round(R.gap_to_median("v", ["grp"]), 4).alias("gap"))


@register(f"""WITH {RELATIVE}, c AS (SELECT a.grp, a.member, count(*) FILTER (b.v < a.v) AS below, count(*) FILTER (b.v = a.v) AS same, count(b.v) AS n FROM rel a JOIN rel b ON a.grp = b.grp WHERE a.v IS NOT NULL GROUP BY 1, 2),
p AS (SELECT grp, member, {_pct('lo')} + CASE WHEN grp % 97 = 0 THEN 0.001 ELSE 0 END AS pct FROM rel)
SELECT count(*) FILTER (abs((below + (same - 1) / 2.0) / (n - 1) - pct) > 1e-7) AS differing, count(*) AS compared FROM c JOIN p USING (grp, member) WHERE n >= 3""")
def percentile_recount(spark, sf_dir):
    """Percentiles, some of them changed, against counting smaller and equal values: a running count over the distinct
    values of a group, joined by value, so a group's rows never meet in pairs."""
    x = values(spark, sf_dir).withColumn("p", F.round(R.percentile_in_group("v", ["grp"]), 8) + F.when(F.col("grp") % 97 == 0, 0.001).otherwise(0.0)).where("v is not null")
    n = x.groupBy("grp", "v").agg(F.count("*").alias("same"))
    upto, whole = R.Window.partitionBy("grp").orderBy("v"), R.Window.partitionBy("grp")
    n = n.select("grp", "v", "same", (F.sum("same").over(upto) - F.col("same")).alias("below"), F.sum("same").over(whole).alias("n")).where("n >= 3")
    counted = (F.col("below") + (F.col("same") - 1) / 2.0) / (F.col("n") - 1)
    return x.join(n, ["grp", "v"]).agg(F.count_if(F.abs(counted - F.col("p")) > 1e-7).alias("differing"), F.count("*").alias("compared"))


@register(f"""WITH {RELATIVE}, ev AS (SELECT grp, member, d, middle - v AS gap, {_pct('hi')} AS pct FROM rel WHERE v IS NOT NULL AND n >= 3),
h AS (SELECT c.grp, c.member, h.gap, h.pct, row_number() OVER (PARTITION BY c.grp, c.member ORDER BY h.d DESC, h.grp DESC) AS r FROM runs c JOIN ev h ON h.member = c.member AND h.d < c.d)
SELECT grp, member, count(*) FILTER (r <= 3) AS n3, round(avg(gap) FILTER (r <= 3), 7) AS gap3, round(median(pct) FILTER (r <= 3), 6) AS pct3, count(*) AS n5, round(avg(gap), 7) AS gap5, round(median(pct), 6) AS pct5 FROM h WHERE r <= 5 GROUP BY 1, 2""")
def relative_history(spark, sf_dir):
    """Of an event's field: how far above the median and at which place its last 3 and 5 events with a field were."""
    x = values(spark, sf_dir)
    n = F.count("v").over(R.Window.partitionBy("grp"))
    x = x.withColumn("n", n).withColumn("gap", -R.gap_to_median("v", ["grp"])).withColumn("pct", F.round(R.percentile_in_group("v", ["grp"], False), 8))
    x = saved(x.select("grp", "member", "d", F.when(F.col("v").isNotNull() & (F.col("n") >= 3), F.struct("gap", "pct")).alias("rel")))
    days, rel = H.prior_days(x, ["member"], "d", {}, (1, ["grp"], ["grp"]), {"rel": 5}).where(F.size("latest_rel") > 0), F.col("latest_rel")
    last = lambda c, k: F.slice(rel[c], 1, k)
    features = [f.alias(f"{name}{k}") for k in (3, 5) for name, f in (("n", F.size(last("gap", k)).cast("long")), ("gap", F.round(C.mean(last("gap", k)), 7)), ("pct", F.round(C.middle(last("pct", k)), 6)))]
    return x.select("grp", "member", "d").join(days.select("member", "d", *features), ["member", "d"]).select("grp", "member", "n3", "gap3", "pct3", "n5", "gap5", "pct5")


@register(f"""WITH {RUNS}, e AS (SELECT grp, member, d, 'late' AS metric, (t - 3 * rating) / 2 AS value FROM runs UNION ALL SELECT grp, member, d, 'start', weight - tax FROM runs),
h AS (SELECT c.grp, c.member, h.metric, h.value, row_number() OVER (PARTITION BY c.grp, c.member, h.metric ORDER BY h.d DESC, h.grp DESC) AS r FROM runs c JOIN e h ON h.member = c.member AND h.d < c.d)
SELECT grp, member, metric, round(median(value) FILTER (r <= 3), 5) AS median3, round(median(value), 5) AS median5 FROM h WHERE r <= 5 GROUP BY 1, 2, 3""")
def pace_history(spark, sf_dir):
    e = runs(spark, sf_dir)
    wide = saved(e.select("grp", "member", "d", ((F.col("t") - 3 * F.col("rating")) / 2).alias("late"), (F.col("weight") - F.col("tax")).alias("start")))
    days = H.prior_days(wide, ["member"], "d", {}, (1, ["grp"], ["grp"]), {"late": 5, "start": 5})
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"latest_{m}").alias("values")) for m in ("late", "start")))).alias("x")
    long = days.select("member", "d", metrics).select("member", "d", "x.*").where(F.size("values") > 0)
    out = wide.select("grp", "member", "d").join(long, ["member", "d"])
    return rounded(out.select("grp", "member", "metric", C.middle(F.slice("values", 1, 3)).alias("median3"), C.middle(F.col("values")).alias("median5")), 5)


COLUMNS = ("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS n_blank, count(DISTINCT {c}) AS n_distinct, count(*) FILTER (TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) = 0) AS n_zero FROM lineitem" for c in COLUMNS))
def column_profile(spark, sf_dir):
    return P.column_profile(table(spark, sf_dir, "lineitem"), COLUMNS)


@register(f"""WITH {RUNS}, x AS (SELECT strftime(d, '%Y-%m') AS year_month, unnest([{{'m': 'v1', 'v': CASE WHEN rating > 10 THEN t END}}, {{'m': 'v2', 'v': CASE WHEN fin THEN weight END}}, {{'m': 'v3', 'v': CAST(rating AS DOUBLE)}}]) AS z FROM runs)
SELECT year_month, z.m AS metric, count(*) AS n_rows, count(z.v) AS n_present FROM x GROUP BY 1, 2""")
def availability_by_month(spark, sf_dir):
    e = runs(spark, sf_dir).select(F.date_format("d", "yyyy-MM").alias("year_month"), F.when(F.col("rating") > 10, F.col("t")).alias("v1"), F.when(F.col("fin"), F.col("weight")).alias("v2"), F.col("rating").alias("v3"))
    return P.availability(e, ["year_month"], ["v1", "v2", "v3"])


@register(f"""WITH {RUNS}, x AS (SELECT strftime(d, '%Y-%m') AS year_month, unnest([{{'r': 'finished', 'v': fin}}, {{'r': 'heavy', 'v': rating >= 25}}]) AS z FROM runs) SELECT year_month, z.r AS rule, round(avg(CAST(z.v AS INTEGER)), 8) AS share FROM x GROUP BY 1, 2""")
def rule_maturity_by_month(spark, sf_dir):
    e = runs(spark, sf_dir).withColumn("year_month", F.date_format("d", "yyyy-MM"))
    return rounded(P.rule_shares(e, ["year_month"], {"finished": F.col("fin"), "heavy": F.col("rating") >= 25}), 8)


@register(f"""WITH {RUNS}, x AS (SELECT pool, unnest([{{'m': 'rating', 'v': CAST(rating AS DOUBLE)}}, {{'m': 't', 'v': CASE WHEN fin THEN t END}}]) AS z FROM runs)
SELECT pool, z.m AS metric, count(*) AS n_rows, round(avg(CASE WHEN z.v IS NULL THEN 1 ELSE 0 END), 6) AS null_rate, round(avg(z.v), 4) AS mean, {", ".join(f"round(quantile_cont(z.v, {q}), 4) AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM x GROUP BY 1, 2""")
def quantile_profile(spark, sf_dir):
    e = runs(spark, sf_dir).select("pool", "rating", F.when(F.col("fin"), F.col("t")).alias("t"))
    out = P.quantile_profile(e, ["pool"], ["rating", "t"])
    return out.select(*(F.round(c, 6 if c == "null_rate" else 4).alias(c) if t == "double" else c for c, t in out.dtypes))


@register(f"WITH {RUNS}, n AS (SELECT strftime(d, '%Y-%m') AS year_month, pool, count(*) AS n_rows FROM runs GROUP BY 1, 2) SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY year_month), 8) AS share FROM n")
def composition_mix(spark, sf_dir):
    return rounded(P.composition(runs(spark, sf_dir).withColumn("year_month", F.date_format("d", "yyyy-MM")), ["year_month"], "pool"), 8)


@register("""WITH l AS (SELECT l_quantity AS a, l_discount AS b, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 50 - (50 - l_quantity) END AS c, CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) THEN -1 ELSE l_quantity END AS d, l_tax AS e, l_tax AS f FROM lineitem)
SELECT x.p AS "left", x.q AS "right" FROM (SELECT unnest([{'p': 'a', 'q': 'b', 'n': count(*) FILTER (a <> b)}, {'p': 'a', 'q': 'c', 'n': count(*) FILTER (a <> c)}, {'p': 'a', 'q': 'd', 'n': count(*) FILTER (a <> d)}, {'p': 'c', 'q': 'd', 'n': count(*) FILTER (c <> d)}, {'p': 'e', 'q': 'f', 'n': count(*) FILTER (e <> f)}]) AS x FROM l) WHERE x.n = 0""")
def equal_columns(spark, sf_dir):
    """Two pairs of equal columns, one that differs in a single order, and others."""
    l, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    last = l.agg(F.max("l_orderkey").alias("last"))
    l = l.crossJoin(F.broadcast(last)).select("l_orderkey", "l_linenumber", "l_partkey", q.alias("a"), F.col("l_discount").alias("b"), F.when(q > 25, q).otherwise(50 - (50 - q)).alias("c"), F.when(F.col("l_orderkey") == F.col("last"), -1.0).otherwise(q).alias("d"), F.col("l_tax").alias("e"), F.col("l_tax").alias("f"))  # one row
    return P.equal_columns(l, ["l_orderkey", "l_linenumber", "l_partkey"], ["a", "b", "c", "d", "e", "f"])


@register("""SELECT (SELECT count(*) FROM lineitem)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_distinct_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_audit(spark, sf_dir):
    return P.key_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(f"""WITH {RUNS} SELECT strftime(d, '%Y-%m') AS year_month, CASE WHEN d < DATE '1997-01-01' THEN 'warm_up' WHEN d < DATE '1999-07-01' THEN 'train' WHEN d < DATE '2000-07-01' THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, round(avg(CAST(hit AS INTEGER)), 8) AS prevalence FROM runs GROUP BY 1, 2""")
def population_by_month(spark, sf_dir):
    from datetime import date

    from pastmark.functions.columns import labelled_range

    e = runs(spark, sf_dir)
    ranges = [("warm_up", date(1900, 1, 1), date(1996, 12, 31)), ("train", date(1997, 1, 1), date(1999, 6, 30)), ("validation", date(1999, 7, 1), date(2000, 6, 30)), ("test", date(2000, 7, 1), date(2999, 1, 1))]
    return e.groupBy(F.date_format("d", "yyyy-MM").alias("year_month"), labelled_range(F.col("d"), ranges).alias("split")).agg(F.count("*").alias("n_rows"), F.countDistinct("grp").alias("n_groups"), F.round(F.avg(F.col("hit").cast("int")), 8).alias("prevalence"))


@register("SELECT l_suppkey, (list_sort(list(DISTINCT l_returnflag || l_linestatus)))[1:5] AS kinds FROM lineitem GROUP BY 1")
def first_distinct_values(spark, sf_dir):
    kinds = F.collect_set(F.concat("l_returnflag", "l_linestatus"))  # six kinds
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.slice(F.sort_array(kinds), 1, 5).alias("kinds"))
