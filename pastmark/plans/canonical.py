"""Staged rows of members and sales made canonical: groups, members with a status, sales, issues, the star and its audit.

A staged member row is a line item with text fields, some of them broken on purpose; a group is an order; staged sales
are seven pools an order, some missing, broken, repeated or without a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import marts
from pastmark.operators import quality as Q
from pastmark.operators.state import saved, small
from pastmark.plans.base import Registry, table
from pastmark.sources.documents import PICKS

register = Registry()
#: Pools and their codes, in order of their keys.
POOLS = dict(zip(PICKS, ("WIN", "PLC", "QNL", "EXA", "QPL", "TLA", "TRI"), strict=True))
#: Seeds: status of a code with a time, and of a code alone, with valid start and finish.
COMPOSITE = [(94, 0, "DNS", False, False), (94, 1, "STOPPED", True, False)]
SINGLE = [(91, "DISQUALIFIED", True, False), (92, "STOPPED", True, False)]

RAW = """
members AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id, CASE WHEN l_orderkey % 113 = 0 AND l_linenumber = 2 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END AS day, CAST(l_orderkey AS VARCHAR) AS no,
  CASE WHEN l_linenumber = 6 AND l_quantity > 45 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS member, CASE WHEN l_quantity <= 16 THEN CAST(l_quantity AS INTEGER) WHEN l_quantity = 50 THEN 94 WHEN l_quantity = 49 THEN 92 WHEN l_quantity = 48 THEN 91 WHEN l_quantity <> 47 THEN 99 END AS ord,
  l_linenumber % 3 AS time, CASE WHEN l_orderkey % 37 = 0 AND l_linenumber = 1 THEN 'wet' ELSE 'dry' END AS track FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
groups AS (SELECT no, day, max(track) AS track, CASE WHEN CAST(no AS BIGINT) % 29 = 0 THEN 'CANCELLED' WHEN CAST(no AS BIGINT) % 31 = 0 THEN 'NOT_FINAL' ELSE 'COMPLETED' END AS group_status FROM members WHERE day <> 'bad' AND member IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT track) <= 1),
canonical AS (SELECT m.no || '|H' || m.member AS member_id, m.no, m.member, CASE WHEN group_status = 'COMPLETED' AND ord BETWEEN 1 AND 16 THEN ord END AS rank,
  CASE WHEN group_status <> 'COMPLETED' THEN group_status WHEN ord BETWEEN 1 AND 16 THEN 'FINISHED' WHEN ord IS NULL THEN 'MISSING' WHEN ord = 94 AND time = 0 THEN 'DNS' WHEN ord = 94 AND time = 1 THEN 'STOPPED' WHEN ord = 91 THEN 'DISQUALIFIED' WHEN ord = 92 THEN 'STOPPED' ELSE 'UNRESOLVED' END AS status,
  group_status = 'COMPLETED' AND coalesce(ord BETWEEN 1 AND 16 OR ord IN (91, 92) OR (ord = 94 AND time = 1), false) AS valid_start, group_status = 'COMPLETED' AND coalesce(ord BETWEEN 1 AND 16, false) AS valid_finish, row_id
  FROM (SELECT *, count(*) OVER (PARTITION BY day, no, member) AS n FROM members WHERE member IS NOT NULL AND day <> 'bad') m JOIN groups g ON g.no = m.no AND g.day = m.day WHERE m.n = 1),
pools AS (SELECT unnest([""" + ", ".join(f"'{p}'" for p in POOLS) + """]) AS pool, unnest([1, 2, 3, 4, 5, 6, 7]) AS pool_key, unnest([""" + ", ".join(f"'{c}'" for c in POOLS.values()) + """]) AS pool_code),
sales AS (SELECT o_orderkey || '-' || pool_key || '-' || copy AS row_id, strftime(o_orderdate, '%Y%m%d') AS day, CASE WHEN o_orderkey % 23 = 0 AND pool_key = 2 THEN 'X' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS no, pool,
  CASE WHEN o_orderkey % 17 = 0 AND pool_key = 1 THEN '-5' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) * pool_key AS VARCHAR) END AS amount FROM orders, pools, (SELECT unnest([1, 2]) AS copy)
  WHERE NOT (o_orderkey % 13 = 0 AND pool_key = 7) AND (copy = 1 OR (o_orderkey % 19 = 0 AND pool_key = 3))),
csales AS (SELECT s.no || '|P' || s.pool AS sales_id, s.no, s.pool, CAST(s.amount AS BIGINT) AS amount, s.row_id FROM (SELECT *, count(*) OVER (PARTITION BY day, no, pool) AS n FROM sales WHERE amount <> '-5') s JOIN groups g ON g.no = s.no AND g.day = s.day WHERE n = 1)
"""


def members(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    ord_ = F.when(q <= 16, q.cast("int")).when(q == 50, 94).when(q == 49, 92).when(q == 48, 91).when(q != 47, 99)
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.when((F.col("l_orderkey") % 113 == 0) & (n == 2), "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), F.col("l_orderkey").cast("string").alias("no"),
        F.when((n == 6) & (q > 45), " ").otherwise(F.col("l_partkey").cast("string")).alias("member"), ord_.cast("string").alias("ord"), (n % 3).cast("string").alias("time"), F.when((F.col("l_orderkey") % 37 == 0) & (n == 1), "wet").otherwise("dry").alias("track"),
    )


def sales_rows(spark, sf_dir):
    key, k = F.col("o_orderkey"), F.col("k")
    pools = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("k"), F.lit(p).alias("pool")) for i, p in enumerate(POOLS))))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", pools.alias("x")).select("*", "x.*")
    o = o.where(~((key % 13 == 0) & (k == 7))).withColumn("copy", F.explode(F.when((key % 19 == 0) & (k == 3), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    amount = F.when((key % 17 == 0) & (k == 1), "-5").otherwise(F.format_number(F.floor("o_totalprice").cast("long") * k, 0))
    return o.select(F.concat_ws("-", "o_orderkey", "k", "copy").alias("row_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.when((key % 23 == 0) & (k == 2), F.concat(F.lit("X"), key)).otherwise(key.cast("string")).alias("no"), "pool", amount.alias("amount"))


def valid_keys(rows):
    return C.parse_date(F.col("day")).isNotNull() & C.blank_to_null(F.col("no")).isNotNull() & C.blank_to_null(F.col("member")).isNotNull()


def exceptions(spark, sf_dir):
    """The groups that did not end as planned, as a keyed table."""
    key = F.col("o_orderkey")
    status = F.when(key % 29 == 0, "CANCELLED").when(key % 31 == 0, "NOT_FINAL")
    return table(spark, sf_dir, "orders").select(key.cast("string").alias("no"), status.alias("group_status")).where("group_status is not null").distinct()


def groups(rows, excepted):
    """(no, day, track, group_status): attributes all rows agree on, status by exception."""
    agreed = Q.promoted(rows.where(valid_keys(rows)), ["no", "day"], ["track"])
    return agreed.join(excepted, "no", "left").fillna("COMPLETED", ["group_status"])


def canonical_members(rows, of_group):
    """Members whose key occurs once in a sound group, with rank, status and validity. Ranks 1 to 16 have finished; the
    group's status comes first, then the rule on code and time, then the one on the code."""
    spark = rows.sparkSession
    once = Q.singletons(rows.where(valid_keys(rows)), ["day", "no", "member"]).join(of_group.select("day", "no", "group_status"), ["day", "no"])
    code, finished = C.parse_int(F.col("ord"))[0], F.coalesce(C.parse_int(F.col("ord"))[0].between(1, 16), F.lit(False))
    both = spark.createDataFrame(COMPOSITE, "code int, time_code int, s2 string, start2 boolean, finish2 boolean")
    single = spark.createDataFrame(SINGLE, "code int, s1 string, start1 boolean, finish1 boolean")
    out = once.withColumn("code", code.cast("int")).withColumn("time_code", C.parse_int(F.col("time"))[0].cast("int")).join(F.broadcast(both), ["code", "time_code"], "left").join(F.broadcast(single), "code", "left")  # a few rules
    done = F.col("group_status") == "COMPLETED"
    status = F.when(~done, F.col("group_status")).when(finished, "FINISHED").when(code.isNull(), "MISSING").otherwise(F.coalesce("s2", "s1", F.lit("UNRESOLVED")))
    valid = lambda name: done & (finished | F.coalesce(f"{name}2", f"{name}1", F.lit(False)))
    return out.select(F.concat(F.col("no"), F.lit("|H"), F.col("member")).alias("member_id"), "no", "member", F.when(done & finished, F.col("code")).alias("rank"), status.alias("status"), valid("start").alias("valid_start"), valid("finish").alias("valid_finish"), "row_id")


def canonical_sales(rows, of_group):
    """One row per group and pool with a sound amount."""
    amount, valid = C.parse_amount(F.col("amount"))
    sound = Q.singletons(rows.withColumn("amount", amount).where(valid), ["day", "no", "pool"])
    return sound.join(of_group.select("day", "no"), ["day", "no"]).select(F.concat(F.col("no"), F.lit("|P"), F.col("pool")).alias("sales_id"), "no", "pool", F.col("amount").cast("long").alias("amount"), "row_id")


def layers(spark, sf_dir):
    rows, sold = members(spark, sf_dir), sales_rows(spark, sf_dir)
    of_group = saved(groups(rows, exceptions(spark, sf_dir)))
    return rows, sold, of_group


@register(f"WITH {RAW} SELECT * FROM groups")
def canonical_groups(spark, sf_dir):
    return layers(spark, sf_dir)[2].select("no", "day", "track", "group_status")


@register(f"WITH {RAW} SELECT * FROM canonical")
def canonical_member_status(spark, sf_dir):
    rows, _, of_group = layers(spark, sf_dir)
    return canonical_members(rows, of_group)


@register(f"WITH {RAW} SELECT * FROM csales")
def canonical_sale_rows(spark, sf_dir):
    _, sold, of_group = layers(spark, sf_dir)
    return canonical_sales(sold, of_group)


ISSUES = {
    "GROUP_CONFLICT": ("ERROR", "members", "Rows of a group disagree on its attributes", "SELECT NULL AS row_id, day || '|' || no AS key, NULL AS value FROM members WHERE day <> 'bad' AND member IS NOT NULL GROUP BY day, no HAVING count(DISTINCT track) > 1"),
    "INVALID_KEY": ("ERROR", "members", "A key is missing or invalid", "SELECT row_id, day || '|' || no || '|H' || coalesce(member, '') AS key, NULL AS value FROM members WHERE day = 'bad' OR member IS NULL"),
    "DUPLICATE_MEMBER": ("ERROR", "members", "Rows share the key of a member", "SELECT row_id, day || '|' || no || '|H' || coalesce(member, '') AS key, NULL AS value FROM members QUALIFY count(*) OVER (PARTITION BY day, no, member) > 1"),
    "INVALID_AMOUNT": ("ERROR", "sales", "The amount is invalid", "SELECT row_id, day || '|' || no || '|P' || pool AS key, amount AS value FROM sales WHERE amount = '-5'"),
    "DUPLICATE_SALE": ("ERROR", "sales", "Rows share the key of a sale", "SELECT row_id, day || '|' || no || '|P' || pool AS key, NULL AS value FROM sales QUALIFY count(*) OVER (PARTITION BY day, no, pool) > 1"),
    "NON_STANDARD_CODE": ("WARNING", "members", "The code is no rank from 1 to 16", "SELECT row_id, day || '|' || no || '|H' || coalesce(member, '') AS key, CAST(ord AS VARCHAR) AS value FROM members WHERE NOT coalesce(ord BETWEEN 1 AND 16, false)"),
    "GROUP_WITHOUT_SALES": ("WARNING", "groups", "A group has no sale", "SELECT NULL AS row_id, no AS key, NULL AS value FROM groups WHERE no NOT IN (SELECT no FROM csales)"),
    "SALE_WITHOUT_GROUP": ("ERROR", "sales", "A sale has no group", "SELECT s.row_id, s.day || '|' || s.no AS key, s.pool AS value FROM sales s LEFT JOIN groups g ON g.no = s.no AND g.day = s.day WHERE g.no IS NULL"),
}


@register(f"WITH {RAW} " + " UNION ALL ".join(f"SELECT md5('{rule}|' || coalesce(row_id, key)) AS issue_id, '{rule}' AS rule, '{severity}' AS severity, '{source}' AS source, row_id, key AS issue_key, value AS issue_value, '{message}' AS message FROM ({sql})" for rule, (severity, source, message, sql) in ISSUES.items()))
def canonical_issues(spark, sf_dir):
    """All rules over staged and canonical rows in one table; nothing is repaired."""
    rows, sold, of_group = layers(spark, sf_dir)
    c = F.col
    member_key, sale_key = F.concat_ws("|", "day", "no", F.concat(F.lit("H"), F.trim("member"))), F.concat_ws("|", "day", "no", F.concat(F.lit("P"), "pool"))
    again = lambda df, keys: df.join(Q.repeated_keys(df, keys).select(*(c(k).alias(f"__{k}") for k in keys)), reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(f"__{k}")) for k in keys)), "left_semi")
    code, none = C.parse_int(c("ord"))[0], F.lit(None).cast("string")
    broken = {
        "GROUP_CONFLICT": (Q.conflicts(rows.where(valid_keys(rows)), ["day", "no"], ["track"]).withColumn("row_id", none), F.concat_ws("|", "day", "no"), none), "INVALID_KEY": (rows.where(~valid_keys(rows)), member_key, none), "DUPLICATE_MEMBER": (again(rows, ["day", "no", "member"]), member_key, none),
        "INVALID_AMOUNT": (sold.where(~C.parse_amount(c("amount"))[1]), sale_key, c("amount")), "DUPLICATE_SALE": (again(sold, ["day", "no", "pool"]), sale_key, none), "NON_STANDARD_CODE": (rows.where(~F.coalesce(code.between(1, 16), F.lit(False))), member_key, c("ord")),
        "GROUP_WITHOUT_SALES": (of_group.join(canonical_sales(sold, of_group), "no", "left_anti").withColumn("row_id", none), c("no"), none), "SALE_WITHOUT_GROUP": (sold.join(of_group, ["day", "no"], "left_anti"), F.concat_ws("|", "day", "no"), c("pool")),
    }
    return Q.issue_table(*(Q.sourced_issues(df, rule, *ISSUES[rule][:3], c("row_id"), key, value) for rule, (df, key, value) in broken.items()))


@register(f"""WITH {RAW} SELECT no, count(*) AS n_members, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in ("FINISHED", "DNS", "STOPPED", "DISQUALIFIED", "MISSING", "UNRESOLVED"))}, count(*) FILTER (status = 'UNRESOLVED') > 0 OR count(*) FILTER (valid_start) < 2 AS to_review FROM canonical GROUP BY 1 HAVING count(*) > count(*) FILTER (status = 'FINISHED')""")
def status_exceptions(spark, sf_dir):
    """Groups with other members than finished ones, by status, and which to review."""
    rows, _, of_group = layers(spark, sf_dir)
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("FINISHED", "DNS", "STOPPED", "DISQUALIFIED", "MISSING", "UNRESOLVED")]
    out = canonical_members(rows, of_group).groupBy("no").agg(F.count("*").alias("n_members"), *counts, F.count_if("valid_start").alias("starts"))
    return out.where("n_members > n_finished").withColumn("to_review", (F.col("n_unresolved") > 0) | (F.col("starts") < 2)).drop("starts")


STAR = RAW + """,
fgroup AS (SELECT g.no, CAST(g.day AS INTEGER) AS date_key, c_nationkey AS venue_key, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS grade_key, group_status, count(s.pool) AS n_pools, count(DISTINCT s.pool) = 7 AS has_all, group_status = 'COMPLETED' AND count(DISTINCT s.pool) = 7 AND count(s.pool) = 7 AS eligible
  FROM groups g JOIN orders ON CAST(o_orderkey AS VARCHAR) = g.no JOIN customer ON o_custkey = c_custkey LEFT JOIN csales s ON s.no = g.no GROUP BY g.no, g.day, c_nationkey, c_mktsegment, group_status),
fsales AS (SELECT sales_id, s.no, date_key, venue_key, grade_key, CAST(pool_key AS INTEGER) AS pool_key, amount, eligible FROM csales s JOIN pools USING (pool) JOIN fgroup f ON f.no = s.no)
"""


def dimensions(spark, sf_dir):
    """The dimensions of the star by name; they take no canonical rows."""
    o, cu = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return {
        "grade": cu.select("c_mktsegment").distinct().withColumn("grade_key", F.row_number().over(Window.orderBy("c_mktsegment"))),  # a dimension
        "pool": spark.createDataFrame([(p, i + 1, code) for i, (p, code) in enumerate(POOLS.items())], "pool string, pool_key int, pool_code string"),
        "venue": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("venue_key"), F.col("n_name").alias("venue_name")),
        "date": marts.date_dimension(o.select(F.to_date("o_orderdate").alias("d")), "d"),
    }


def star(spark, sf_dir):
    """(groups' facts, sales' facts, canonical groups, canonical sales, dimensions by name)."""
    _, sold, of_group = layers(spark, sf_dir)
    sales = saved(canonical_sales(sold, of_group))
    dims, o, cu = dimensions(spark, sf_dir), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    of_order = o.join(cu, o.o_custkey == cu.c_custkey).select(F.col("o_orderkey").cast("string").alias("no"), F.col("c_nationkey").alias("venue_key"), "c_mktsegment").join(small(dims["grade"]), "c_mktsegment")
    pools = sales.groupBy("no").agg(F.count("*").alias("n_pools"), F.countDistinct("pool").alias("kinds"))
    out = of_group.join(of_order, "no").join(pools, "no", "left").fillna(0, ["n_pools", "kinds"])
    has_all = F.col("kinds") == len(POOLS)
    fact = out.select("no", F.col("day").cast("int").alias("date_key"), "venue_key", "grade_key", "group_status", "n_pools", has_all.alias("has_all"), ((F.col("group_status") == "COMPLETED") & has_all & (F.col("n_pools") == len(POOLS))).alias("eligible"))
    fact = saved(fact)
    sale = sales.join(small(dims["pool"]), "pool").join(fact.select("no", "date_key", "venue_key", "grade_key", "eligible"), "no").select("sales_id", "no", "date_key", "venue_key", "grade_key", "pool_key", "amount", "eligible")
    return fact, sale, of_group, sales, dims


@register(f"WITH {STAR} SELECT * FROM fgroup")
def fact_group(spark, sf_dir):
    return star(spark, sf_dir)[0]


@register(f"WITH {STAR} SELECT * EXCLUDE (eligible) FROM fsales WHERE eligible")
def market_sales(spark, sf_dir):
    """The sales of eligible groups, with four dimension keys."""
    return star(spark, sf_dir)[1].where("eligible").drop("eligible")


@register(f"WITH {RAW} SELECT 'pool' AS dimension, CAST(pool_key AS BIGINT) AS key, pool AS label, pool_code AS code FROM pools UNION ALL SELECT 'grade', row_number() OVER (ORDER BY c_mktsegment), c_mktsegment, NULL FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'venue', n_nationkey, n_name, NULL FROM nation")
def star_dimensions(spark, sf_dir):
    dims, none = dimensions(spark, sf_dir), F.lit(None).cast("string")
    long = lambda name, key, label, code: dims[name].select(F.lit(name).alias("dimension"), F.col(key).cast("long").alias("key"), F.col(label).alias("label"), code.alias("code"))
    return long("pool", "pool_key", "pool", F.col("pool_code")).unionByName(long("grade", "grade_key", "c_mktsegment", none)).unionByName(long("venue", "venue_key", "venue_name", none))


@register(f"""WITH {STAR}, n AS (SELECT CAST(no AS BIGINT) AS k, * FROM fgroup), s AS (SELECT CAST(no AS BIGINT) AS k, * FROM fsales)
SELECT (SELECT count(*) FROM n WHERE k % 47 = 0) AS missing_groups, (SELECT count(*) FROM s WHERE k % 53 = 0 AND pool_key = 4) AS missing_sales, (SELECT count(*) FROM n WHERE k % 59 = 0 AND k % 47 <> 0) AS broken_keys, (SELECT count(*) FROM n WHERE k % 61 = 0 AND k % 47 <> 0) AS wrong_eligibility,
(SELECT count(DISTINCT no) FROM s WHERE eligible AND k % 53 = 0) AS incomplete_groups, (SELECT count(*) FROM s WHERE k % 67 = 0 AND pool_key = 5) AS repeated_sales,
CAST((SELECT coalesce(sum(amount), 0) FROM s WHERE k % 53 = 0 AND pool_key = 4) - (SELECT coalesce(sum(amount), 0) FROM s WHERE k % 67 = 0 AND pool_key = 5) AS BIGINT) AS amount_gap""")
def star_audit(spark, sf_dir):
    """A star with planted faults against its sources: counts, keys, eligibility, seven pools a group, sums, repeats."""
    fact, sale, of_group, sales, dims = star(spark, sf_dir)
    k, c = F.col("no").cast("long"), F.col
    fact = fact.where(k % 47 != 0).withColumn("venue_key", F.when(k % 59 == 0, 99).otherwise(c("venue_key"))).withColumn("eligible", F.when(k % 61 == 0, ~c("eligible")).otherwise(c("eligible")))
    sale = sale.where(~((k % 53 == 0) & (c("pool_key") == 4)))
    sale = saved(sale.unionByName(sale.where((k % 67 == 0) & (c("pool_key") == 5))))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    complete = (c("group_status") == "COMPLETED") & c("has_all") & (c("n_pools") == len(POOLS))
    parts = [
        one(of_group.join(fact, "no", "left_anti"), "missing_groups"), one(sales.join(sale, "sales_id", "left_anti"), "missing_sales"),
        one(fact.join(small(dims["venue"]), "venue_key", "left").join(small(dims["grade"]), "grade_key", "left").where("venue_name is null or c_mktsegment is null"), "broken_keys"), fact.agg(F.count_if(c("eligible") != complete).alias("wrong_eligibility")),
        one(sale.where("eligible").groupBy("no").agg(F.countDistinct("pool_key").alias("kinds")).where(c("kinds") != len(POOLS)), "incomplete_groups"), Q.repeated_keys(sale, ["sales_id"]).agg(F.coalesce(F.sum(c("n_rows") - 1), F.lit(0)).alias("repeated_sales")),
        sales.agg(F.sum("amount").alias("a")).crossJoin(sale.agg(F.sum("amount").alias("b"))).select((c("a") - c("b")).alias("amount_gap")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


EXPECTED = {
    "WIN": "r1", "QNL": "CASE WHEN r2 = 0 THEN r1 * (r1 - 1) // 2 ELSE r1 * r2 END", "EXA": "CASE WHEN r2 = 0 THEN r1 * (r1 - 1) ELSE r1 * r2 END", "QPL": "(r1 + r2 + r3) * (r1 + r2 + r3 - 1) // 2",
    "TLA": "CASE WHEN r2 = 0 THEN r1 * (r1 - 1) // 2 * r3 WHEN r3 = 0 THEN r1 * r2 * (r2 - 1) // 2 ELSE r1 * r2 * r3 END", "TRI": "CASE WHEN r2 = 0 THEN r1 * (r1 - 1) * r3 WHEN r3 = 0 THEN r1 * r2 * (r2 - 1) ELSE r1 * r2 * r3 END",
}


@register(f"""WITH k AS (SELECT l_orderkey AS grp, rank() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) // 10 DESC) AS rank FROM lineitem), n AS (SELECT grp, count(*) FILTER (rank = 1) AS r1, count(*) FILTER (rank = 2) AS r2, count(*) FILTER (rank = 3) AS r3 FROM k GROUP BY 1),
x AS ({" UNION ALL ".join(f"SELECT grp, '{pool}' AS pool, {sql} AS expected FROM n" for pool, sql in EXPECTED.items())})
SELECT pool, count(*) AS n_groups, CAST(sum(expected) AS BIGINT) AS expected, count(*) FILTER (grp % 41 = 0) AS mismatched FROM x GROUP BY 1""")
def tied_combinations(spark, sf_dir):
    """Winning combinations that ranks with ties allow in each pool, against the counts of a table of payouts in which
    the groups of a number have one too many."""
    tens = F.floor(F.col("l_quantity").cast("int") / 10)
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc(tens))).alias("rank"))
    observed = saved(ranked.where("rank <= 3"))
    expected = marts.tied_counts(observed, "grp", "rank")
    # Payouts from the members themselves: sets of places that win, by counting members on each place.
    paid = marts.winning_sets(observed, "grp", "rank").withColumn("paid", F.col("paid") + F.when(F.col("grp") % 41 == 0, 1).otherwise(0))
    both = expected.join(paid, ["grp", "pool"], "left").fillna(0, ["paid"])
    return both.groupBy("pool").agg(F.count("*").alias("n_groups"), F.sum("expected").alias("expected"), F.count_if(F.col("paid") != F.col("expected")).alias("mismatched"))


@register(f"""WITH {RAW}, k AS (SELECT *, CAST(no AS BIGINT) AS n FROM canonical) SELECT (SELECT count(*) FROM k) + (SELECT count(*) FROM k WHERE n % 101 = 0) AS n_rows, (SELECT count(*) FROM k WHERE n % 101 = 0) AS repeated_members, (SELECT count(*) * 1 FROM k WHERE n % 97 = 0) + (SELECT count(*) FROM k WHERE n % 97 = 0 AND n % 101 = 0) AS rank_outside,
(SELECT count(*) FROM k WHERE n % 89 = 0) + (SELECT count(*) FROM k WHERE n % 89 = 0 AND n % 101 = 0) AS no_source, (SELECT count(*) FROM k WHERE n % 83 = 0) + (SELECT count(*) FROM k WHERE n % 83 = 0 AND n % 101 = 0) AS no_group, (SELECT count(*) FROM k WHERE n % 79 = 0 AND n % 97 <> 0) + (SELECT count(*) FROM k WHERE n % 79 = 0 AND n % 97 <> 0 AND n % 101 = 0) AS finish_mismatch, (SELECT count(*) FROM csales WHERE amount < 1000) AS small_amounts FROM (SELECT 1)""")
def canonical_audit(spark, sf_dir):
    """Canonical rows with planted faults: repeated members, ranks outside 1 to 16, rows of no staged row or no group,
    finishes without a rank."""
    rows, sold, of_group = layers(spark, sf_dir)
    c, n = F.col, F.col("no").cast("long")
    out = canonical_members(rows, of_group)
    out = out.withColumn("valid_finish", F.when(n % 79 == 0, ~c("valid_finish")).otherwise(c("valid_finish"))).withColumn("rank", F.when(n % 97 == 0, 17).otherwise(c("rank"))).withColumn("row_id", F.when(n % 89 == 0, F.concat(F.lit("none-"), "row_id")).otherwise(c("row_id")))
    out = out.withColumn("of", F.when(n % 83 == 0, F.concat(F.lit("none-"), "no")).otherwise(c("no")))
    out = saved(out.unionByName(out.where(n % 101 == 0)))
    in_range = c("rank").between(1, 16)
    parts = [
        Q.rule_counts(out, {"rank_outside": ~in_range, "finish_mismatch": F.coalesce(in_range, F.lit(True)) & (c("valid_finish") != c("rank").isNotNull())}),
        Q.repeated_keys(out, ["member_id"]).agg(F.coalesce(F.sum(c("n_rows") - 1), F.lit(0)).alias("repeated_members")), out.join(rows.select("row_id"), "row_id", "left_anti").agg(F.count("*").alias("no_source")),
        out.join(of_group.select(c("no").alias("of")), "of", "left_anti").agg(F.count("*").alias("no_group")), canonical_sales(sold, of_group).agg(F.count_if(c("amount") < 1000).alias("small_amounts")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


@register("""WITH old AS (SELECT n_nationkey AS code, n_name AS label, 0 AS load_no FROM nation), fresh AS (SELECT CAST(c_custkey % 40 AS INTEGER) AS code, c_name AS label, c_custkey AS load_no FROM customer WHERE c_custkey % 40 >= 20),
last AS (SELECT code, arg_max(label, load_no) AS label, max(load_no) AS load_no FROM fresh GROUP BY 1) SELECT coalesce(f.code, o.code) AS code, coalesce(f.label, o.label) AS label, CAST(coalesce(f.load_no, o.load_no) AS BIGINT) AS load_no FROM old o FULL JOIN last f ON f.code = o.code""")
def seed_upsert(spark, sf_dir):
    """A keyed seed table with newer rows over it, which repeat their keys: the last load counts."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.lit(0).cast("long").alias("load_no"))
    fresh = table(spark, sf_dir, "customer").where("c_custkey % 40 >= 20").select((F.col("c_custkey") % 40).cast("int").alias("code"), F.col("c_name").alias("label"), F.col("c_custkey").alias("load_no"))
    return marts.upserted(old, fresh, ["code"], "load_no")
