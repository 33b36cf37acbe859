"""Market queries: scope, summaries by month, venue and pool, shares, Pareto front, rate mix, star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import marts
from pastmark.operators.relative import joined_quantiles
from pastmark.operators.state import small
from pastmark.plans.base import PREDS, RUNS, Registry, preds, rounded, runs, table

register = Registry()

SALES = "sales AS (SELECT o_orderkey, o_custkey, o_orderpriority AS pool, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS d, c_nationkey AS venue, c_mktsegment AS grade FROM orders JOIN customer ON o_custkey = c_custkey)"


def sales(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("pool"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("d"), F.col("c_nationkey").alias("venue"), F.col("c_mktsegment").alias("grade"))


@register(f"WITH {SALES} SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, min(d) AS first_day, max(d) AS last_day, count(DISTINCT pool) AS n_pools, round(sum(amount), 2) AS total FROM sales")
def market_scope(spark, sf_dir):
    return sales(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_groups"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.countDistinct("pool").alias("n_pools"), F.round(F.sum("amount"), 2).alias("total"))


@register(f"""WITH {SALES}, s AS (SELECT strftime(d, '%Y-%m') AS year_month, o_custkey, sum(CAST(amount AS DECIMAL(18, 2))) AS x FROM sales GROUP BY ALL)
SELECT year_month, count(*) AS n_groups, CAST(sum(x) AS DOUBLE) / count(x) AS mean_total, round(median(CAST(x AS DOUBLE)), 4) AS median_total FROM s GROUP BY 1""")
def market_by_month(spark, sf_dir):
    return marts.group_total_summary(sales(spark, sf_dir).withColumn("year_month", F.date_format("d", "yyyy-MM")), ["year_month"], "o_custkey", "amount").withColumn("median_total", F.round("median_total", 4))


def _summary_sql(*dims):
    cols = ", ".join(dims)
    return f"WITH {SALES}, s AS (SELECT *, strftime(d, '%Y-%m') AS year_month FROM sales) SELECT {cols}, count(DISTINCT o_custkey) AS n_groups, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) / count(amount) AS mean, round(median(amount), 4) AS median FROM s GROUP BY {cols}"


def _summary(spark, sf_dir, *dims):
    return marts.summary(sales(spark, sf_dir).withColumn("year_month", F.date_format("d", "yyyy-MM")), dims, "amount", "o_custkey").withColumn("median", F.round("median", 4))


@register(_summary_sql("year_month", "pool"))
def summary_month_pool(spark, sf_dir):
    return _summary(spark, sf_dir, "year_month", "pool")


@register(_summary_sql("venue", "pool"))
def summary_venue_pool(spark, sf_dir):
    return _summary(spark, sf_dir, "venue", "pool")


@register(_summary_sql("grade", "pool"))
def summary_grade_pool(spark, sf_dir):
    return _summary(spark, sf_dir, "grade", "pool")


@register(_summary_sql("grade", "venue", "pool"))
def summary_grade_venue_pool(spark, sf_dir):
    return _summary(spark, sf_dir, "grade", "venue", "pool")


@register(f"""WITH {SALES}, s AS (SELECT venue, o_custkey, sum(CAST(amount AS DECIMAL(18, 2))) AS x FROM sales GROUP BY ALL)
SELECT venue, count(*) AS n_groups, CAST(sum(x) AS DOUBLE) / count(x) AS mean_total, round(median(CAST(x AS DOUBLE)), 4) AS median_total FROM s GROUP BY 1""")
def market_by_venue(spark, sf_dir):
    return marts.group_total_summary(sales(spark, sf_dir), ["venue"], "o_custkey", "amount").withColumn("median_total", F.round("median_total", 4))


@register(f"""WITH {SALES}, s AS (SELECT grade, o_custkey, sum(CAST(amount AS DECIMAL(18, 2))) AS x FROM sales GROUP BY ALL)
SELECT grade, count(*) AS n_groups, CAST(sum(x) AS DOUBLE) / count(x) AS mean_total, round(median(CAST(x AS DOUBLE)), 4) AS median_total FROM s GROUP BY 1""")
def market_by_grade(spark, sf_dir):
    return marts.group_total_summary(sales(spark, sf_dir), ["grade"], "o_custkey", "amount").withColumn("median_total", F.round("median_total", 4))


@register(f"WITH {SALES} SELECT pool, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, round(median(amount), 4) AS median FROM sales GROUP BY 1")
def market_by_pool(spark, sf_dir):
    s = sales(spark, sf_dir)
    out = marts.summary(s, ["pool"], "amount", "o_custkey").join(s.groupBy("pool").agg(F.count("*").alias("n_rows")), "pool")
    return out.select("pool", "n_rows", "n_groups", "mean", F.round("median", 4).alias("median"))


@register(f"WITH {SALES} SELECT pool, round(sum(amount), 2) AS total, round(sum(amount) / sum(sum(amount)) OVER (), 8) AS share FROM sales GROUP BY 1")
def share_of_total(spark, sf_dir):
    out = marts.share_of_total(sales(spark, sf_dir), ["pool"], "amount")
    return out.select("pool", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@register(f"WITH {SALES} SELECT venue, pool, round(sum(amount), 2) AS total, round(sum(amount) / sum(sum(amount)) OVER (PARTITION BY venue), 8) AS share FROM sales GROUP BY 1, 2")
def pool_share_by_venue(spark, sf_dir):
    out = marts.share_of_total(sales(spark, sf_dir), ["venue", "pool"], "amount", ["venue"])
    return out.select("venue", "pool", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@register("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
s AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month,
strftime(day, '%Y-%m') AS year_month, CAST(date_trunc('month', day) AS DATE) AS month_start, CAST(isodow(day) AS INTEGER) AS iso_weekday, strftime(day, '%a') AS weekday_name FROM s""")
def date_dimension(spark, sf_dir):
    return marts.date_dimension(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), "d")


@register(f"""WITH {SALES}, g AS (SELECT o_custkey, venue, count(*) AS n_rows, count(DISTINCT pool) AS n_pools FROM sales GROUP BY ALL)
SELECT *, n_pools = 5 AS has_all, n_pools = 5 AND n_rows = 5 AS eligible FROM g""")
def eligible_groups(spark, sf_dir):
    return marts.eligible_groups(sales(spark, sf_dir), ["o_custkey", "venue"], "pool", 5)


@register(f"""WITH {SALES}, dp AS (SELECT pool, row_number() OVER (ORDER BY pool) AS pool_key FROM (SELECT DISTINCT pool FROM sales)),
g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT pool) AS p FROM sales GROUP BY 1)
SELECT o_orderkey, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, venue AS venue_key, CAST(pool_key AS INTEGER) AS pool_key, grade, amount FROM sales JOIN dp USING (pool) JOIN g USING (o_custkey) WHERE p = 5""")
def fact_sales(spark, sf_dir):
    from pyspark.sql import Window

    s = sales(spark, sf_dir)
    pools = s.select("pool").distinct().withColumn("pool_key", F.row_number().over(Window.orderBy("pool")))  # a dimension
    whole = s.groupBy("o_custkey").agg(F.countDistinct("pool").alias("p")).where("p = 5")
    return s.join(small(pools), "pool").join(whole, "o_custkey", "left_semi").select("o_orderkey", F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), F.col("venue").alias("venue_key"), "pool_key", "grade", "amount")


COUNTS = """m AS (SELECT pool, median(amount) AS middle, quantile_cont(amount, 0.95) AS high, quantile_cont(amount, 0.95) / median(amount) AS tail, count(*) AS n FROM sales GROUP BY 1)"""


@register(f"""WITH {SALES}, {COUNTS} SELECT pool, round(middle, 4) AS middle, round(high, 4) AS high, round(tail, 6) AS tail, n,
NOT EXISTS (SELECT 1 FROM m o WHERE o.pool <> m.pool AND o.middle >= m.middle AND o.n >= m.n AND o.tail <= m.tail AND (o.middle > m.middle OR o.n > m.n OR o.tail < m.tail)) AS on_front FROM m""")
def pareto_front(spark, sf_dir):
    s = sales(spark, sf_dir)
    m = joined_quantiles(s.groupBy("pool").agg(F.count("*").alias("n")), s, "amount", ["pool"], {"middle": 0.5, "high": 0.95})
    m = m.withColumn("tail", F.col("high") / F.col("middle"))
    out = marts.pareto_front(m, "pool", ["middle", "n"], ["tail"])
    return out.select("pool", F.round("middle", 4).alias("middle"), F.round("high", 4).alias("high"), F.round("tail", 6).alias("tail"), "n", "on_front")


@register("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS picks), o AS (SELECT unnest([false, true]) AS ordered)
SELECT n, picks, ordered, count(*) AS n_groups, CAST(CASE picks WHEN 1 THEN n WHEN 2 THEN n * (n - 1) / (CASE WHEN ordered THEN 1 ELSE 2 END) ELSE n * (n - 1) * (n - 2) / (CASE WHEN ordered THEN 1 ELSE 6 END) END AS DOUBLE) AS ways
FROM g, k, o GROUP BY 1, 2, 3""")
def combination_counts(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_groups"))
    g = g.withColumn("picks", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("ordered", F.explode(F.array(F.lit(False), F.lit(True))))
    return g.select("n", "picks", "ordered", "n_groups", C.combinations(F.col("n"), F.col("picks"), F.col("ordered")).alias("ways"))


@register(f"""WITH {PREDS}, c AS (SELECT dist, count(*) FILTER (period = 'STABLE') AS n0, count(*) FILTER (period = 'SHIFTED') AS n1, count(*) FILTER (period = 'STABLE' AND y = 1) AS h0, count(*) FILTER (period = 'SHIFTED' AND y = 1) AS h1 FROM preds GROUP BY 1)
SELECT round(sum(h0) / sum(n0), 8) AS first_rate, round(sum(h1) / sum(n1), 8) AS second_rate, round(sum(n1 * h0 / nullif(n0, 0)) / sum(n1) FILTER (n0 > 0), 8) AS second_mix_at_first_rates FROM c""")
def rate_mix_decomposition(spark, sf_dir):
    return rounded(marts.rate_mix(preds(spark, sf_dir), "dist", "period", "STABLE", "SHIFTED", F.col("y") == 1), 8)


STATUS = """pair AS (SELECT * FROM (VALUES ('R', 'F', 'RETURNED_LATE'), ('A', 'O', 'REVIEW')) v(f, s, status)), single AS (SELECT * FROM (VALUES ('R', 'RETURNED'), ('A', 'ACCEPTED')) v(f, status))"""


@register(f"""WITH {STATUS} SELECT l_returnflag, l_linestatus, coalesce(b.status, s.status, 'NORMAL') AS status, count(*) AS n_rows FROM lineitem LEFT JOIN pair b ON b.f = l_returnflag AND b.s = l_linestatus LEFT JOIN single s ON s.f = l_returnflag GROUP BY ALL""")
def status_policy_join(spark, sf_dir):
    both = spark.createDataFrame([("R", "F", "RETURNED_LATE"), ("A", "O", "REVIEW")], "l_returnflag string, l_linestatus string, status string")
    single = spark.createDataFrame([("R", "RETURNED"), ("A", "ACCEPTED")], "l_returnflag string, status string")
    out = marts.status_policy(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), both, single, ("l_returnflag", "l_linestatus"), "NORMAL")
    return out.groupBy("l_returnflag", "l_linestatus", "status").agg(F.count("*").alias("n_rows"))


@register(f"""WITH {RUNS} SELECT pool, round(quantile_cont(t, 0.1), 5) AS p10, round(median(t), 5) AS p50, round(quantile_cont(t, 0.9), 5) AS p90, count(*) AS n, count(*) FILTER (rk = 1) AS n_first FROM runs GROUP BY 1""")
def price_profile_by_pool(spark, sf_dir):
    from pastmark.plans.base import placed

    rows = placed(runs(spark, sf_dir))
    out = rows.groupBy("pool").agg(F.count("*").alias("n"), F.count_if(F.col("rk") == 1).alias("n_first"))
    return rounded(joined_quantiles(out, rows, "t", ["pool"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}), 5)


@register("""SELECT nullif(trim(p_type), '') AS kind, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type IN ('PROMO', 'LARGE') THEN 'high' ELSE p_type END AS class,
CASE WHEN p_size <= 8 THEN '<=8' WHEN p_size <= 11 THEN '9-11' ELSE '12+' END AS band, p_brand || '|' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS part_class, count(*) AS n_rows, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY ALL""")
def label_and_band(spark, sf_dir):
    kind = C.normalise(F.col("p_type"), {"low": ("ECONOMY", "SMALL"), "high": ("PROMO", "LARGE")})
    key = C.composite_key(F.col("p_brand"), C.padded(F.col("p_size"), 3))
    out = table(spark, sf_dir, "part").groupBy(C.blank_to_null(F.col("p_type")).alias("kind"), kind.alias("class"), C.band(F.col("p_size"), [8, 11]).alias("band"), key.alias("part_class"))
    return out.agg(F.count("*").alias("n_rows"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))
