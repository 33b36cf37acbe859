"""Jobs that must take all of their rows: what a cut would leave out is counted here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastmark.operators import evaluate as E
from pastmark.operators import models as M
from pastmark.plans import QUERIES, canonical
from pastmark.plans.base import preds

SF = "/root/testdata/sf0.001"


def test_rows_are_numbered_in_order(spark):
    keys = [0, 3, 4, 5, 9, 40, 41, 1000, 1001, 70000, 10**9]
    out = E.numbered(spark.createDataFrame([(k,) for k in keys[::-1]], "k long"), "k", width=4)
    assert [r.k for r in out.orderBy("i").collect()] == keys and sorted(r.i for r in out.collect()) == list(range(len(keys)))


def test_resampled_means_have_the_moments_of_draws_with_replacement(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET_VALUES", 100)  # several buckets
    random = np.random.default_rng(1)
    x = random.random(730)
    rows = spark.createDataFrame([(k, float(v), 1.0) for k, v in enumerate(x)], "k long, v double, one double")
    out = E.resampled(rows, "k", ["v", "one"], {"few": 7, "all": 730}, 2100)
    got = {s: [(r.draw, r.v, r.one) for r in out.where(F.col("sample") == s).collect()] for s in ("few", "all")}
    for name, size in (("few", 7), ("all", 730)):
        assert sorted(d for d, _, _ in got[name]) == list(range(2100))
        assert all(one == pytest.approx(1) for _, _, one in got[name])  # a draw's buckets add up to its size
        means, sd = np.array([v for _, v, _ in got[name]]), x.std() / size**0.5
        assert abs(means.mean() - x.mean()) < 5 * sd / 2100**0.5
        assert means.std() == pytest.approx(sd, rel=0.08)
    again = {(r["sample"], r.draw): r.v for r in E.resampled(rows.repartition(5), "k", ["v"], {"few": 7, "all": 730}, 2100).collect()}
    assert all(again[s, d] == pytest.approx(v) for s in got for d, v, _ in got[s])


def test_bootstrap_draws_from_all_groups(spark):
    out = {(r.kind, r["sample"], r.metric): r for r in QUERIES["bootstrap_stability"](spark, SF).collect()}
    groups = E.group_losses(preds(spark, SF), ["period", "grp"]).toPandas()
    months = preds(spark, SF).where("period = 'SHIFTED'").groupBy(F.date_format("d", "yyyy-MM").alias("m")).agg(F.countDistinct("grp").alias("n")).collect()
    assert {(k, s): r.n for (k, s, m), r in out.items() if m == "brier" and k == "month"} == {("month", m.m): m.n for m in months}
    assert sum(r.n for (k, _, m), r in out.items() if k == "block" and m == "brier") == sum(m.n for m in months)
    assert {r.draws for r in out.values()} == {10_000}
    late, stable = groups[groups.period == "SHIFTED"], groups[groups.period == "STABLE"]
    for metric in ("log_loss", "brier"):
        r = out["late", "all", metric]
        assert r.n == len(late) and r.actual == pytest.approx(late[metric].mean())
        sd = late[metric].std(ddof=0) / len(late) ** 0.5
        assert r["mean"] == pytest.approx(late[metric].mean(), abs=5 * sd / 100)
        assert r.p97_5 - r.p2_5 == pytest.approx(2 * 1.96 * sd, rel=0.06) and r.p75 - r.p25 == pytest.approx(2 * 0.6745 * sd, rel=0.06)
        assert r.p2_5 < r.p5 < r.p25 < r.p50 < r.p75 < r.p95 < r.p97_5
        for m in months:
            r = out["month", m.m, metric]
            sd = stable[metric].std(ddof=0) / m.n**0.5
            assert r["mean"] == pytest.approx(stable[metric].mean(), abs=5 * sd / 100)
            assert 0 <= r.share_at_or_above <= 1 and (r.share_at_or_above > 0.5) == (r.p50 >= r.actual) or r.p50 == pytest.approx(r.actual, abs=sd / 10)


def test_predictions_start_after_three_months(spark):
    rows = preds(spark, SF)
    first = rows.agg(F.min("d")).first()[0]
    due = rows.where(F.col("d") >= F.add_months(F.trunc(F.lit(first), "month"), 3))
    out = QUERIES["oof_predictions"](spark, SF)
    assert out.count() == due.count() and out.where("p is null").count() == 0
    quarters = due.select(F.floor(F.months_between(F.trunc("d", "month"), F.trunc(F.lit(first), "month")) / 3)).distinct().count()
    assert out.select("fold").distinct().count() == quarters
    # A block's model is of all rows before the block and of no other.
    begin = sorted(r.fold for r in out.select("fold").distinct().collect())[1]
    train, block = rows.where(F.col("d") < F.lit(begin)), rows.where((F.col("d") >= F.lit(begin)) & (F.col("d") < F.add_months(F.lit(begin), 3)))
    x = M.prepare(train, ["rating", "t"], categories=["pool"]).vector()
    own = M.probabilities(M.logistic(train.withColumn("features", x)), block.withColumn("features", x))
    expected = {(r.grp, r.member): r.p for r in own.collect()}
    got = {(r.grp, r.member): r.p for r in out.where(F.col("fold") == F.lit(begin)).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_feature_sets_are_compared_on_every_quarter(spark):
    rows = preds(spark, SF)
    first = rows.agg(F.min("d")).first()[0]
    due = rows.where(F.col("d") >= F.add_months(F.trunc(F.lit(first), "month"), 3))
    n = {r.model: (r.folds, r.n) for r in QUERIES["feature_set_comparison"](spark, SF).groupBy("model").agg(F.countDistinct("fold").alias("folds"), F.sum("n_rows").alias("n")).collect()}
    folds = QUERIES["oof_predictions"](spark, SF).select("fold").distinct().count()
    assert n == {"base": (folds, due.count()), "more": (folds, due.count())}


def test_all_pools_of_all_orders_are_parsed_or_rejected(spark, tmp_path):
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 15, 7: 16, 8: 49, 9: 1200}
    spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    good, rejected = {}, set()
    for r in QUERIES["parse_pools"](spark, str(tmp_path)).collect():
        if r.rejected:
            assert r.text and r.members is None
            rejected.add((r.l_orderkey, r.pool))
        else:
            good.setdefault((r.l_orderkey, r.pool), []).append((r.combination_no, r.members, r.ordered, r.odds))
    expected, broken = {}, set()
    for k, n in sizes.items():
        for pool, picks in {"단식": 1, "연식": 1, "복식": 2, "쌍식": 2, "복연": 2, "삼복": 3, "삼쌍": 3}.items():
            rows = [(j, [[n - j + 1], [n, j], [n, j, j + 1]][picks - 1], (n + j) / 2) for j in range(1, min(n, 3) + 1)]
            if any(len(set(m)) < picks or max(m) > 16 for _, m, _ in rows):
                broken.add((k, pool))
            else:
                ordered = pool in ("쌍식", "삼쌍")
                expected[k, pool] = [(j, m if ordered else sorted(m), ordered, odds) for j, m, odds in rows]
    assert rejected == broken and {key: sorted(v) for key, v in good.items()} == expected


def test_every_query_is_registered_once_and_has_columns_of_its_sql():
    from pastmark.plans import MODULES, SQL

    names = [n for m in MODULES for n in m.register.queries]
    assert len(names) == len(set(names)) == len(QUERIES) and set(SQL) <= set(names)


def test_the_snapshot_has_125_features():
    from pastmark.plans import place

    assert len(place.FEATURES) == len(set(place.FEATURES)) == 125
    assert [len(x) for x in (place.F1, place.F2, place.F3)] == [6, 8, 10]


def test_the_snapshot_moves_few_rows(spark):
    """Histories meet the starts where these are: at most half of the 109 exchanges that a join for each history took, and
    starts stay dealt by member and day."""
    from pastmark.plans import place

    events = place.starts(spark, SF)
    plan = place.full_snapshot(events)._jdf.queryExecution().sparkPlan
    whole = place.full_snapshot(events)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") <= 54 and "Cartesian" not in whole
    assert plan is not None and "Scan ExistingRDD" in whole


def test_a_table_is_no_broadcast_for_its_small_files(spark):
    """The keys and days of 150,000 orders are 0.9 MB of the files by Spark's count and over 3.6 MB as rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
    try:
        rows = canonical.members(spark, "/root/testdata/sf0.1")
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        dims = canonical.table(spark, "/root/testdata/sf0.1", "customer").join(canonical.table(spark, "/root/testdata/sf0.1", "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        assert "BroadcastHashJoin" in dims._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dimensions_take_no_canonical_rows(spark, monkeypatch):
    """They are small tables of their own; the star they belong to is not made for them."""
    monkeypatch.setattr(canonical, "layers", lambda *_: pytest.fail("canonical rows were made"))
    out = QUERIES["star_dimensions"](spark, SF).groupBy("dimension").count().collect()
    assert {r.dimension: r["count"] for r in out} == {"pool": 7, "grade": 5, "venue": 25}


def test_the_baseline_is_never_better_than_itself(spark):
    """Losses that come out a little different each time they are made, as sums of many rows do."""
    noise = F.udf(lambda x: x + __import__("random").random() * 1e-12, "double").asNondeterministic()
    rows = [(f, m, 0.2 + f / 100 + (m == "b") / 50) for f in range(20) for m in "ab"] + [(99, "b", 0.5), (None, "a", 0.5)]
    losses = spark.createDataFrame(rows, "fold int, model string, x double").select("fold", "model", noise("x").alias("loss"))
    out = {r.model: r for r in M.fold_summary(losses, "a").collect()}
    assert out["a"].improved == 0 and out["a"].mean_delta == 0.0
    assert out["b"].improved == 0 and out["b"].mean_delta == pytest.approx(0.02) and out["b"]["mean"] == pytest.approx(0.315)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_smaller_snapshot_does_not_move_its_starts(spark):
    """Histories by day come to the starts; one join for each by the ids moved the starts each time."""
    assert exchanges(QUERIES["place_snapshot_small"](spark, SF)) <= 14


def test_starts_are_dealt_with_what_is_taken_of_them(spark, monkeypatch):
    """A start has 42 columns; the smaller snapshot and the bundles take less than half of them."""
    from pastmark.plans import place

    dealt, widths = place.dealt, []
    monkeypatch.setattr(place, "dealt", lambda df, keys: widths.append(len(df.columns)) or dealt(df, keys))
    for name in ("place_snapshot_small", "feature_bundles"):
        QUERIES[name](spark, SF)
    assert widths == [19, 19]
