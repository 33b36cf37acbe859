"""Quality rules and audits over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pastmark.operators import quality as Q
from pastmark.plans.base import RUNS, Registry, placed, runs, table

register = Registry()
KEY = ["l_orderkey", "l_partkey"]


@register("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1")
def singleton_rule(spark, sf_dir):
    return Q.singletons(table(spark, sf_dir, "lineitem").select(*KEY, "l_suppkey", "l_quantity"), KEY)


@register("""SELECT md5('DUPLICATE_MEMBER|' || l_orderkey || '|' || l_partkey) AS issue_id, 'DUPLICATE_MEMBER' AS rule, 'ERROR' AS severity, l_orderkey || '|' || l_partkey AS issue_key, CAST(count(*) AS VARCHAR) AS issue_value FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""")
def duplicate_key_issues(spark, sf_dir):
    bad = Q.repeated_keys(table(spark, sf_dir, "lineitem"), KEY)
    return Q.issues(bad, "DUPLICATE_MEMBER", "ERROR", F.concat_ws("|", *KEY), F.col("n_rows"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@register("""SELECT l_orderkey, x.attribute, x.lowest, x.highest FROM (SELECT l_orderkey, unnest([
{'attribute': 'l_returnflag', 'lowest': min(l_returnflag), 'highest': max(l_returnflag)}, {'attribute': 'l_linestatus', 'lowest': min(l_linestatus), 'highest': max(l_linestatus)}]) AS x FROM lineitem GROUP BY 1) WHERE x.lowest <> x.highest""")
def attribute_conflict(spark, sf_dir):
    return Q.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@register("SELECT l_orderkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <= 1 AND count(DISTINCT l_linestatus) <= 1")
def promoted_attributes(spark, sf_dir):
    return Q.promoted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@register("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k)
SELECT *, round(shared / nullif(shared + only_left, 0), 8) AS left_rate, round(shared / nullif(shared + only_right, 0), 8) AS right_rate FROM c""")
def key_reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = Q.reconcile(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])
    return out.select("shared", "only_left", "only_right", F.round("left_rate", 8).alias("left_rate"), F.round("right_rate", 8).alias("right_rate"))


@register(f"""WITH {RUNS}, bad AS (SELECT grp || '|' || member AS k, rating FROM runs WHERE rating >= 50),
nolines AS (SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT md5('HIGH_RATING|' || k) AS issue_id, 'HIGH_RATING' AS rule, 'WARNING' AS severity, k AS issue_key, CAST(rating AS VARCHAR) AS issue_value FROM bad
UNION ALL SELECT md5('ORDER_WITHOUT_LINES|' || k), 'ORDER_WITHOUT_LINES', 'WARNING', CAST(k AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM nolines""")
def issue_table(spark, sf_dir):
    high = runs(spark, sf_dir).where("rating >= 50")
    empty = orphan_rows(spark, sf_dir)
    return Q.issue_table(Q.issues(high, "HIGH_RATING", "WARNING", F.concat_ws("|", "grp", "member"), F.col("rating")), Q.issues(empty, "ORDER_WITHOUT_LINES", "WARNING", F.col("o_orderkey"), F.col("o_custkey")))


@register(f"""WITH {RUNS} SELECT venue, count(*) AS n_rows, count(*) FILTER (rating < 1 OR rating > 50) AS bad_rating, count(*) FILTER (weight > 0.1) AS bad_weight, count(*) FILTER (t <= 0) AS bad_price, count(*) FILTER (fin AND hit) AS both_flags FROM runs GROUP BY 1""")
def rule_counts_by_venue(spark, sf_dir):
    c = F.col
    return Q.rule_counts(runs(spark, sf_dir), {"bad_rating": (c("rating") < 1) | (c("rating") > 50), "bad_weight": c("weight") > 0.1, "bad_price": c("t") <= 0, "both_flags": c("fin") & c("hit")}, ["venue"])


@register("SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n_places, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)")
def line_sequence_audit(spark, sf_dir):
    return Q.sequence_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register(f"""WITH {RUNS}, g AS (SELECT grp, count(*) AS n, count(*) FILTER (rk <= 2) AS in_place, sum(CASE WHEN fin THEN 1 ELSE 0 END) AS n_fin FROM runs GROUP BY 1)
SELECT n, count(*) AS n_groups, count(*) FILTER (in_place <> least(n, 2)) AS mismatched, CAST(sum(n_fin * (n_fin - 1) / 2) AS DOUBLE) AS expected_pairs FROM g GROUP BY 1""")
def expected_combinations(spark, sf_dir):
    from pastmark.functions.columns import combinations

    g = placed(runs(spark, sf_dir)).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("rk") <= 2).alias("in_place"), F.count_if("fin").alias("n_fin"))
    return g.groupBy("n").agg(F.count("*").alias("n_groups"), F.count_if(F.col("in_place") != F.least("n", F.lit(2))).alias("mismatched"), F.sum(combinations(F.col("n_fin"), F.lit(2), F.lit(False))).alias("expected_pairs"))


@register("""SELECT field, count(*) AS compared, count(*) FILTER (same) AS equal FROM (
SELECT z.f AS field, z.s AS same FROM (SELECT unnest([{'f': 'supplier', 's': a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey}, {'f': 'flag', 's': a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag}]) AS z
FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) b USING (l_orderkey, l_linenumber))) GROUP BY 1""")
def field_agreement(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    side = lambda f: l.groupBy("l_orderkey", "l_linenumber").agg(f("l_suppkey").alias("supplier"), f("l_returnflag").alias("flag"))
    return Q.agreement(side(F.min), side(F.max), ["l_orderkey", "l_linenumber"], ["supplier", "flag"])


@register("SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) <= 3")
def top_rows_per_supplier(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return Q.first_rows(l, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber"], 3).drop("l_linenumber")


@register("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus AS status, lag(o_orderstatus) OVER w AS previous, lag(o_orderdate) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT previous, status, count(*) AS n_rows, CAST(max(date_diff('day', CAST(before AS DATE), CAST(o_orderdate AS DATE))) AS INTEGER) AS widest FROM o WHERE previous IS NOT NULL GROUP BY 1, 2""")
def status_transitions(spark, sf_dir):
    """From which status of an entity's last event to which of the next."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.lag("o_orderstatus").over(order).alias("previous"), F.datediff("o_orderdate", F.lag("o_orderdate").over(order)).alias("days"))
    return o.where("previous is not null").groupBy("previous", "status").agg(F.count("*").alias("n_rows"), F.max("days").alias("widest"))


@register("""WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, n_rows DESC, o_orderpriority) AS place FROM n ORDER BY place LIMIT 7""")
def labelled_order(spark, sf_dir):
    """The first seven cells in the order of their labels, not of their letters, then by size."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_rows"))
    label = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    order = [label, F.desc("n_rows"), F.col("o_orderpriority")]
    return n.withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy(*order).limit(7)  # a row per pair of labels


@register("""WITH g AS (SELECT o_orderpriority AS pool, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), m AS (SELECT pool, n, count(*) AS n_groups FROM g GROUP BY 1, 2) SELECT pool, n, n_groups, round(n_groups / sum(n_groups) OVER (PARTITION BY pool), 8) AS share, n_groups < 0.05 * sum(n_groups) OVER (PARTITION BY pool) AS unusual FROM m""")
def unusual_counts(spark, sf_dir):
    """How many members groups of a pool have, and which counts are rare."""
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pool"))
    n = l.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("pool", "n").agg(F.count("*").alias("n_groups"))
    whole = F.sum("n_groups").over(Window.partitionBy("pool"))
    return n.withColumn("share", F.round(F.col("n_groups") / whole, 8)).withColumn("unusual", F.col("n_groups") < 0.05 * whole)
