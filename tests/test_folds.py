"""Models of all folds at once against plain fits of each."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastmark.operators import evaluate as E
from pastmark.operators import folds as L
from pastmark.operators import intervals as I
from pastmark.operators import models as M

BLOCKS = [(date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 3, 1), date(2020, 3, 20)), (date(2020, 4, 1), date(2020, 4, 30))]


@pytest.fixture(scope="module")
def table():
    random = np.random.default_rng(6)
    rows = []
    for i in range(900):
        d = date(2020, 1, 1) + timedelta(days=int(random.integers(0, 120)))
        a, b = random.normal(3, 2), random.normal(-1, 0.1)
        cat = str(random.choice(["x", "y", "z"])) if d < date(2020, 3, 1) else str(random.choice(["x", "y", "new"]))
        y = int(random.random() < 1 / (1 + np.exp(-(0.6 * (a - 3) - (cat == "x")))))
        rows.append((i, i // 6, d, None if random.random() < 0.2 else float(a), float(b), None if random.random() < 0.3 else int(random.integers(0, 5)), bool(random.random() < 0.5), None if random.random() < 0.1 else cat, y))
    return rows


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, "i long, g long, d date, a double, b double, n int, f boolean, c string, y int").repartition(5)


def inputs(train, rows):
    """By hand: medians, modes, standardising, one-hot, from the training rows."""
    col = lambda rs, k: [r[k] for r in rs]
    parts = [np.ones(len(rows))]
    for k, kind in ((3, "number"), (4, "number"), (5, "count")):
        known = [v for v in col(train, k) if v is not None]
        fill = float(np.median(known)) if kind == "number" else 0.0
        filled = lambda rs, k=k, fill=fill: np.array([fill if v is None else v for v in col(rs, k)], float)
        parts.append((filled(rows) - filled(train).mean()) / filled(train).std())
    parts.append(np.array(col(rows, 6), float))
    known = [v for v in col(train, 7) if v is not None]
    mode = min(set(known), key=lambda v: (-known.count(v), v))
    for v in sorted(set(known)):
        parts.append(np.array([(mode if x is None else x) == v for x in col(rows, 7)], float))
    return np.stack(parts, axis=1)


def newton(x, y, weight=None, ridge=None):
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * b)
    return b


def test_every_fold_and_set_is_the_plain_fit(frame, table):
    sets = {"all": L.Features(("a", "b"), ("n",), ("f",), ("c",)), "small": L.Features(("b",))}
    folds = L.Folds(frame, "d", BLOCKS, sets, keep=["i"])
    out = {(r.model, r.i): r for r in folds.fit().scored().collect()}
    assert len(out) == 2 * sum(any(a <= r[2] <= b for a, b in BLOCKS) for r in table)
    for begin, last in BLOCKS:
        train, block = [r for r in table if r[2] < begin], [r for r in table if begin <= r[2] <= last]
        for name, columns in (("all", slice(None)), ("small", [0, 2])):
            x = inputs(train, train)[:, columns]
            b = newton(x, np.array([r[8] for r in train]), ridge=np.r_[0.0, np.ones(x.shape[1] - 1)])
            for r, p in zip(block, 1 / (1 + np.exp(-inputs(train, block)[:, columns] @ b)), strict=True):
                assert out[name, r[0]].fold == begin and out[name, r[0]].p == pytest.approx(p, abs=1e-9)
    base = {r.i: r.p for r in folds.plain("base").collect()}
    assert base[next(r[0] for r in table if r[2] == date(2020, 3, 5))] == pytest.approx(np.mean([r[8] for r in table if r[2] < date(2020, 3, 1)]))


def test_the_ranker_learns_from_earlier_groups_only(frame, table):
    table = [(*r[:2], table[r[1] * 6][2], *r[3:]) for r in table]  # a group has one day
    frame = frame.sparkSession.createDataFrame(table, frame.schema)
    folds = L.Folds(frame, "d", BLOCKS, {"r": L.Features(("a", "b"))}, keep=["i", "g"])
    out = {r.i: r.score for r in folds.fit(pairs=L.ranker_pairs(folds.rows, "g", "y", ["a", "b"])).scored(as_name="score", probability=False).collect()}
    for begin, last in BLOCKS:
        train, block = [r for r in table if r[2] < begin], [r for r in table if begin <= r[2] <= last]
        x, differences, weights = inputs(train, train)[:, 1:3], [], []
        for g in {r[1] for r in train}:
            own = [k for k, r in enumerate(train) if r[1] == g]
            hits, misses = [k for k in own if train[k][8]], [k for k in own if not train[k][8]]
            differences += [s * (x[i] - x[j]) for i in hits for j in misses for s in (1, -1)]
            weights += [1 / max(1, 2 * len(hits) * len(misses))] * (2 * len(hits) * len(misses))
        y = np.tile([1.0, 0.0], len(differences) // 2)
        b = newton(np.array(differences), y, np.array(weights), np.ones(2))
        for r, s in zip(block, inputs(train, block)[:, 1:3] @ b, strict=True):
            assert out[r[0]] == pytest.approx(s, abs=1e-8)


def test_the_number_of_jobs_is_that_of_the_steps(spark, frame):
    def jobs(blocks, sets):
        spark.sparkContext.setJobGroup(f"folds-{len(blocks)}-{len(sets)}", "")
        L.Folds(frame, "d", blocks, sets).fit()
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{len(blocks)}-{len(sets)}")
        spark.sparkContext.setJobGroup("other", "")
        return len(found)

    weeks = [(date(2020, 2, 1) + timedelta(days=3 * k), date(2020, 2, 3) + timedelta(days=3 * k)) for k in range(20)]
    many = {f"s{k}": L.Features(("b",)) for k in range(4)}
    assert jobs(weeks, many) <= jobs(BLOCKS[:1], {"s": L.Features(("b",))}) + 12  # a step or two more to settle, not 80 fits


def test_folds_without_two_classes_or_rows(spark, frame):
    early = frame.withColumn("y", F.when(F.col("d") < "2020-02-15", 0).otherwise(F.col("y")))
    folds = L.Folds(early, "d", BLOCKS, {"s": L.Features(("b",))})
    assert folds.folds == [1, 2] and {r.fold for r in folds.fit().scored().collect()} == {BLOCKS[1][0], BLOCKS[2][0]}
    with pytest.raises(ValueError, match="both classes"):
        L.Folds(frame.withColumn("y", F.lit(1)), "d", BLOCKS, {"s": L.Features(("b",))}).fit()
    with pytest.raises(ValueError, match="overlap"):
        L.Folds(frame, "d", BLOCKS[::-1], {"s": L.Features(("b",))})
    assert L.expanding(frame.where("y > 1"), "d") == []
    assert L.month_blocks(date(2019, 11, 9), date(2020, 6, 1), 3, 3) == [(date(2020, 2, 1), date(2020, 4, 30)), (date(2020, 5, 1), date(2020, 7, 31))]


def test_calibration_refuses_one_class(spark):
    rows = spark.createDataFrame([("a", 1, 0.4), ("a", 1, 0.6), ("b", 0, 0.3), ("b", 1, 0.3)], "seg string, y int, p double")
    with pytest.raises(ValueError, match="both classes"):
        E.calibration(rows.where("seg = 'a'"))
    with pytest.raises(ValueError, match="both classes"):
        E.calibration(rows.where("y > 1"))
    assert {r.seg: (r.intercept, r.slope) for r in E.calibration(rows, ["seg"]).collect()} == {"a": (None, None), "b": (0.0, None)}


def test_trees_split_categories_by_sets(spark):
    """Every other category is a hit, so no split by the categories' order separates the classes and one by a set does."""
    names = [f"c{k}" for k in range(10)]
    rows = spark.createDataFrame([(names[i % 10], float(i % 7), i % 10 % 2) for i in range(400)], "c string, x double, y int")
    x = M.indexed(rows, ["x"], ["c"])
    model = M.boosted(rows.select("y", x), rounds=1, depth=1)
    later = rows.union(spark.createDataFrame([("never seen", 1.0, 0), (None, 1.0, 0)], rows.schema))
    out = M.probabilities(model, later.select("c", "y", x)).collect()
    known = [r for r in out if r.c in names]
    assert all((r.p > 0.5) == (r.y == 1) for r in known) and len(out) == 402
    tree = model.trees[0]._java_obj.rootNode().split()
    assert tree.getClass().getSimpleName() == "CategoricalSplit" and sorted(tree.leftCategories()) in ([1, 3, 5, 7, 9], [0, 2, 4, 6, 8], [0, 2, 4, 6, 8, 10], [1, 3, 5, 7, 9, 10])


def test_points_meet_the_intervals_that_hold_them(spark):
    random = np.random.default_rng(4)
    points = [(i, int(v)) for i, v in enumerate(random.integers(-50, 600, 300))] + [(300, None)]
    intervals = [(k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(random.integers(-60, 600, 200), random.integers(-3, 300, 200), strict=True))] + [(200, None, 5), (201, 5, None), (202, -(2**35), 2**35), (203, 7, 7)]
    p, i = spark.createDataFrame(points, "i int, v int"), spark.createDataFrame(intervals, "k int, lo long, hi long")
    joined = I.interval_join(p, F.col("v"), i, F.col("lo"), F.col("hi"))
    expected = sorted((a, k) for a, v in points for k, lo, hi in intervals if None not in (v, lo, hi) and lo <= v <= hi)
    assert sorted((r.i, r.k) for r in joined.collect()) == expected and len(expected) > 5000
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    assert I.interval_join(p, F.col("v"), i.where("k > 999"), F.col("lo"), F.col("hi")).count() == 0


def test_many_long_periods_take_few_cells(spark):
    """A hundred thousand overlapping periods: each is cut in at most two cells a level."""
    periods = spark.range(100_000).select((F.col("id") % 5000).alias("lo"), (F.col("id") % 5000 + F.col("id") % 997).alias("hi"))
    cut = periods.select(F.size(I.cells_of(F.col("lo"), F.col("hi"))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert cut[0] <= 20
    days = spark.range(6000).withColumnRenamed("id", "day")
    out = I.interval_join(days, F.col("day"), periods, F.col("lo"), F.col("hi")).agg(F.count("*").alias("n"), F.sum("day").alias("s")).first()
    lo = np.arange(100_000) % 5000
    length = np.arange(100_000) % 997 + 1
    assert (out.n, out.s) == (int(length.sum()), int((length * lo + length * (length - 1) // 2).sum()))


def test_stability_of_patterns_with_missing_places(spark):
    rows = [("a", f, b, v) for f, vs in {1: [1.0, 2.0, 3.0], 2: [2.0, 4.0, None], 3: [3.0, 2.0, 1.0]}.items() for b, v in enumerate(vs) if v is not None] + [("b", 1, 0, -1.0), ("b", 1, 1, -2.0), ("c", 1, 0, 1.0), ("c", 2, 1, 1.0)]
    cells = spark.createDataFrame(rows, "k string, f int, b int, v double")
    out = {r.k: r for r in E.stability(cells, ["k"], ["b"], "f", "v", [1, 2, 3, 4], 2).collect()}
    assert (out["a"].n_folds, out["a"].median_spread, out["a"].common_cells, out["a"].same_sign_cells) == (3, 2.0, 2, 2)
    assert out["a"].median_correlation == pytest.approx(-1)  # of 1, -1 and -1
    assert (out["b"].n_folds, out["b"].median_correlation, out["b"].common_cells, out["b"].same_sign_cells) == (1, None, 2, 2)
    assert (out["c"].n_folds, out["c"].median_correlation, out["c"].common_cells) == (2, None, 0)
    assert {r.k: r.same_direction for r in E.directions(cells, ["k"], "b", "f", "v").collect()} == {"a": 2, "b": 1, "c": 0}
