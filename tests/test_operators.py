"""Hand-worked cases of the operators outside the training-data package."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import evaluate as E
from pastmark.operators import history as H
from pastmark.operators import marts, models
from pastmark.operators import quality as Q
from pastmark.operators import relative as R
from pastmark.sources import documents as D


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_values(spark):
    seconds = [one(spark, C.parse_seconds(F.lit(x)).cast("double"))[0] for x in ("75.9", "0", "bad")]
    assert seconds == [75.9, None, None]
    weights = {x: one(spark, *C.parse_weight(F.lit(x))) for x in ("502(-2)", "388(+1)", "480()", "()", "502")}
    assert weights == {"502(-2)": (502, -2), "388(+1)": (388, 1), "480()": (480, 0), "()": (None, None), "502": (502, None)}
    tracks = [one(spark, *C.parse_track(F.lit(x))) for x in ("건조 (2%)", "다습(12%)", " ")]
    assert tracks == [("건조", 2), ("다습", 12), (None, None)]
    amounts = [one(spark, *C.parse_amount(F.lit(x))) for x in ("1,000", "-5", "1.5", "", "7.0")]
    assert [(int(a) if a is not None else None, v) for a, v in amounts] == [(1000, True), (None, False), (None, False), (None, False), (7, True)]
    splits = [one(spark, C.split_seconds(F.lit(by), F.lit(72.4), F.lit(33.1), F.lit(39.0)))[0] for by in (True, False)]
    assert splits == [pytest.approx(39.3), 39.0]


def test_documents(spark):
    item = '{"rcDate":"20240105","meet":"1","chulNo":"1","n":{"a":[1]}}'
    body = lambda x, total=1, code="00": f'{{"response":{{"header":{{"resultCode":"{code}"}},"body":{{"totalCount":{total},"items":{{"item":{x}}}}}}}}}'
    bodies = [("a", body(item)), ("b", body(f"[{item},{item}]", 2)), ("c", ""), ("d", "{"), ("e", body("[]", 0)), ("f", body(item, 1, "99")), ("g", '{"x":1}'), ("h", None)]
    frame = spark.createDataFrame(bodies, "file_id string, body string")
    rows = D.exploded(frame, ["rcDate", "n", "gone"]).orderBy("file_id", "position").collect()
    assert [(r.file_id, r.position, r.rcDate, r.n, r.gone) for r in rows] == [("a", 1, "20240105", '{"a":[1]}', None), ("b", 1, "20240105", '{"a":[1]}', None), ("b", 2, "20240105", '{"a":[1]}', None), ("f", 1, "20240105", '{"a":[1]}', None)]
    status = {r.file_id: r.s for r in frame.select("file_id", D.payload_status(F.col("body"), F.lit(200), F.lit("1"), "meet").alias("s")).collect()}
    assert status == {"a": "SUCCESS", "b": "SUCCESS", "c": "EMPTY_BODY", "d": "INVALID_JSON", "e": "NO_DATA", "f": "API_ERROR", "g": "INVALID_SCHEMA", "h": "EMPTY_BODY"}
    batch = D.exploded(frame, ["rcDate"])
    assert D.new_rows(batch, batch.limit(0)).count() == 4 and D.new_rows(batch, batch).count() == 0


def test_winning_combinations(spark):
    texts = [("복연", "(16)⑪-18.8  (16)⑦-46.9  ⑪⑦-56.9"), ("복식", "③①-7"), ("쌍식", "③①-9"), ("복식", "①-2.3"), ("단식", "①-2.3"), ("삼복", "①①②-5.0"), ("복식", None)]
    good, rejected = D.winning_combinations(spark.createDataFrame(texts, "pool string, odds string"))
    out = [(r.pool, r.combination_no, r.members, float(r.odds_value), r.ordered) for r in good.orderBy("pool", "combination_no").collect()]
    assert out == [("단식", 1, [1], 2.3, False), ("복식", 1, [1, 3], 7.0, False), ("복연", 1, [11, 16], 18.8, False), ("복연", 2, [7, 16], 46.9, False), ("복연", 3, [7, 11], 56.9, False), ("쌍식", 1, [3, 1], 9.0, True)]
    assert sorted(str(r.odds) for r in rejected.collect()) == ["None", "①-2.3", "①①②-5.0"]


def test_point_in_time(spark):
    rows = [("R1", "H1", 5, True, 1, 31, True), ("R1", "H2", 5, True, 2, 32, True), ("R2", "H1", 12, False, None, 33, False), ("R2", "H2", 12, True, 1, 34, True), ("R3", "H1", 19, True, 2, 35, True), ("R3", "H2", 19, False, None, 36, False)]
    events = spark.createDataFrame([(a, b, date(2024, 1, d), *rest) for a, b, d, *rest in rows], "grp string, member string, d date, fin boolean, rk int, rating int, hit boolean")
    one_if = lambda c: F.when(F.col(c), 1).otherwise(0)
    prior = H.with_prior(events, ["member"], "d", {"fins": ("sum", one_if("fin")), "hits": ("sum", one_if("hit")), "last": ("max", F.col("d"))})
    r = prior.where("grp = 'R3' and member = 'H1'").first()
    assert (r.n_prior, r.fins, r.hits, r["last"]) == (2, 1, 1, date(2024, 1, 12))
    assert prior.where("n_prior = 0").count() == 2
    days = H.prior_days(events, ["member"], "d", {}, (5, ["grp"], ["fin"]))
    assert [x.fin for x in days.where("d = '2024-01-19' and member = 'H1'").first()["last"]] == [False, True]
    last = H.last_n_sums(events, ["member"], "d", ["grp"], ["grp", "member"], 1, {"hits": one_if("hit").cast("long")})
    assert {(r.grp, r.member): (r.last_n_count, r.hits) for r in last.collect()} == {("R1", "H1"): (0, 0), ("R1", "H2"): (0, 0), ("R2", "H1"): (1, 1), ("R2", "H2"): (1, 1), ("R3", "H1"): (1, 0), ("R3", "H2"): (1, 1)}


def test_same_day_events_do_not_see_each_other(spark):
    rows = [("a", "x", date(2024, 1, 1)), ("b", "x", date(2024, 1, 1)), ("c", "x", date(2024, 1, 2)), ("d", None, date(2024, 1, 2))]
    events = spark.createDataFrame(rows, "grp string, member string, d date")
    assert {r.grp: r.n_prior for r in H.with_prior(events, ["member"], "d", {}).collect()} == {"a": 0, "b": 0, "c": 2, "d": None}


def test_percentiles_and_bins(spark):
    x = spark.createDataFrame([(1, v) for v in (10.0, 20.0, 20.0, 40.0, None)] + [(2, 1.0), (2, 2.0)], "grp int, v double")
    out = sorted((r.grp, r.v or 0, r.p) for r in x.withColumn("p", R.percentile_in_group("v", ["grp"])).collect())
    assert out == [(1, 0, None), (1, 10.0, 0.0), (1, 20.0, 0.5), (1, 20.0, 0.5), (1, 40.0, 1.0), (2, 1.0, None), (2, 2.0, None)]
    n = spark.range(1, 12).withColumn("g", F.lit(1)).withColumn("b", R.equal_count_bin(["id"], ["g"], 5))
    assert [r.b for r in n.orderBy("id").collect()] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_ranking_and_topk(spark):
    rows = [("r1", "b", 1, 0.9), ("r1", "a", 0, 0.9), ("r1", "c", 1, 0.8), ("r1", "d", 0, 0.1)]
    preds = spark.createDataFrame(rows, "grp string, member string, y int, p double")
    r = E.ranking_metrics(preds.withColumn("y", F.when(F.col("member").isin("a", "c"), 1).otherwise(0)), "grp", "member").first()
    assert (r.top1, r.recall1, r.recall3) == (1.0, 0.5, 1.0)
    assert {r.k: r.any_hit for r in E.topk_hits(preds, "grp", "member").collect()} == {1: 0.0, 2: 1.0, 3: 1.0}


def test_decomposition_adds_up(spark):
    rows = [(8, "A", 0.2), (8, "A", 0.3), (10, "A", 0.4), (12, "A", 0.1), (8, "B", 0.5), (10, "B", 0.6), (10, "B", 0.2), (14, "B", 0.9)]
    r = E.mix_decomposition(spark.createDataFrame(rows, "n int, period string, loss double"), "n", "period", "A", "B", "loss").first()
    assert abs(r.residual) < 1e-12 and r.total_change == pytest.approx(0.55 - 0.25)


def test_calibration(spark):
    rows = [("a", int(k % 10 < 10 * p), p) for p in (0.2, 0.5, 0.8) for k in range(100)] + [("b", k % 2, 0.3) for k in range(10)] + [("c", 1, 0.1 * k) for k in range(1, 9)]
    out = {r.seg: (r.intercept, r.slope) for r in E.calibration(spark.createDataFrame(rows, "seg string, y int, p double"), ["seg"]).collect()}
    assert out["a"] == (pytest.approx(0, abs=1e-6), pytest.approx(1, abs=1e-6))
    assert out["b"] == (pytest.approx(0, abs=1e-9), None) and out["c"] == (None, None)


def test_pairs(spark):
    rows = [("r1", 1, 1.0), ("r1", 1, 2.0), ("r1", 0, 0.0), ("r1", 0, 5.0), ("r2", 1, 1.0), ("r2", 0, 3.0), ("r2", 0, 4.0), ("r3", 1, 1.0), ("r3", 1, 2.0)]
    pairs = models.directed_pairs(spark.createDataFrame(rows, "grp string, y int, f double"), "grp", "y", ["f"])
    assert pairs.count() == 12
    assert {r.grp: round(r.w, 9) for r in pairs.groupBy("grp").agg(F.sum("weight").alias("w")).collect()} == {"r1": 1.0, "r2": 1.0}


def test_logistic_matches_newton(spark):
    import numpy as np

    random = np.random.default_rng(0)
    x = random.standard_normal((400, 2))
    y = (random.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.3)))).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    prep = models.prepare(rows, ["a", "b"])
    model = models.logistic(rows.withColumn("features", prep.vector()))
    z = np.column_stack([(x - np.array([prep.numbers[c][1] for c in "ab"])) / np.array([prep.numbers[c][2] for c in "ab"]), np.ones(400)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T * (p * (1 - p)) @ z + np.diag([1, 1, 0]), z.T @ (y - p) - w * [1, 1, 0])
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-5)


def test_quality_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, None)], "k int, v string")
    assert sorted(r.k for r in Q.singletons(rows, ["k"]).collect()) == [3]
    assert [(r.k, r.attribute, r.lowest, r.highest) for r in Q.conflicts(rows, ["k"], ["v"]).collect()] == [(1, "v", "a", "b")]
    assert sorted((r.k, r.v) for r in Q.promoted(rows, ["k"], ["v"]).collect()) == [(2, "c"), (3, None)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in marts.upserted(old, new, ["k"]).collect()) == [(1, "x"), (2, "z")]
    twice = new.union(spark.createDataFrame([(2, "a"), (3, None)], "k int, v string"))
    with pytest.raises(Exception, match="repeated key"):
        marts.upserted(old, twice, ["k"]).collect()
    loads = spark.createDataFrame([(2, "z", 4), (2, "a", 9), (2, "b", None), (3, None, 1), (3, "q", 1)], "k int, v string, load int")
    out = marts.upserted(old.withColumn("load", F.lit(0)), loads, ["k"], "load").collect()
    assert sorted(tuple(r) for r in out) == [(1, "x", 0), (2, "a", 9), (3, "q", 1)]


def test_layers_are_switched_when_written(spark, tmp_path):
    folder, rows = str(tmp_path / "layer"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    D.write_versioned(rows, folder, "1", ["k"])
    D.write_versioned(rows.limit(1), folder, "2")
    assert D.read_current(spark, folder).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        D.write_versioned(rows, folder, "1", ["k"])
    assert D.read_current(spark, folder).count() == 1
    D.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("1", "a"), ("2", "b")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"a":\n1}')
    assert [r.body for r in D.read_documents(spark, str(tmp_path / "docs")).collect()] == ['{"a":\n1}']


def test_a_layer_stays_when_the_next_one_fails(spark, tmp_path):
    """A write that breaks half-way, an audit that finds faults, a repeated version: readers go on with the old one."""
    folder, rows = str(tmp_path / "layer"), spark.range(100).withColumn("k", F.col("id") % 3)
    now = lambda: D.read_current(spark, folder).agg(F.count("*"), F.max("id")).first()
    audit = lambda df: df.agg(F.count_if(F.col("id") < 0).alias("n_broken")).select(F.lit("negative").alias("rule"), "n_broken")
    D.write_versioned(rows, folder, "1", audit=audit)
    broken = rows.withColumn("k", F.when(F.col("id") == 77, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="half-way"):
        D.write_versioned(broken, folder, "2", audit=audit)
    assert now() == (100, 99)
    with pytest.raises(D.Refused, match="negative"):
        D.write_versioned(rows.withColumn("id", F.col("id") - 1), folder, "3", audit=audit)
    assert now() == (100, 99)
    D.write_versioned(rows.where("id < 50"), folder, "4", ["k"], audit)
    assert now() == (50, 49)
    assert [p.name for p in (tmp_path / "layer").iterdir() if "current" in p.name and not p.name.endswith(".crc")] == ["current"]


def test_readers_find_a_version_during_the_switch(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "layer")
    for version in "ab":
        D.write_versioned(spark.range(3).withColumn("v", F.lit(version)), folder, version)
    done = []

    def read():
        seen = set()
        while not done:
            seen |= set(D.read_current(spark, folder).columns)
        return seen

    with ThreadPoolExecutor(2) as pool:
        readers = [pool.submit(read) for _ in range(2)]
        try:
            for i in range(60):
                D.switch(spark, folder, "ab"[i % 2])
        finally:
            done.append(True)
        assert all(r.result() == {"id", "v"} for r in readers)


def test_stored_files_are_read_as_they_are(spark, tmp_path):
    docs = spark.createDataFrame([("a-1", "x"), ("b-2", "yy")], "file_id string, body string")
    D.store_documents(docs, str(tmp_path / "files"))
    stored = D.stored_documents(spark, str(tmp_path / "files"))
    assert {(r.file_id, r.size, bytes(r.content)) for r in stored.collect()} == {("a-1", 2, b"x\n"), ("b-2", 3, b"yy\n")}
    manifest = stored.select("file_id", "size", F.sha2("content", 256).alias("sha256"))
    assert D.file_audit(manifest, stored).count() == 0
    bad = manifest.where("file_id = 'a-1'").withColumn("size", F.lit(9).cast("long")).unionByName(spark.createDataFrame([("c-3", 1, "h")], "file_id string, size long, sha256 string"))
    assert {tuple(r) for r in D.file_audit(bad, stored).collect()} == {("a-1", "SIZE"), ("b-2", "UNLISTED"), ("c-3", "MISSING")}


def test_whole_numbers_of_any_size(spark):
    rows = spark.createDataFrame([(t,) for t in ("7", " -12 ", "99999999999", "1.5", "", "x", None)], "t string")
    value, valid = C.parse_int(F.col("t"))
    assert [(None if r.v is None else int(r.v), r.ok) for r in rows.select(value.alias("v"), valid.alias("ok")).collect()] == [(7, True), (-12, True), (99999999999, True), (None, False), (None, False), (None, False), (None, False)]


def test_windows_and_folds_are_checked(spark):
    rows = spark.createDataFrame([(date(2024, m, 5), m % 2) for m in range(1, 13)], "d date, y int")
    assert models.bounded(rows, "d", date(2024, 3, 1), date(2024, 12, 31)).count() == 10
    with pytest.raises(ValueError, match="after"):
        models.bounded(rows, "d", date(2024, 3, 1), date(2024, 11, 30))
    folds = models.dated_folds(rows, "d", [(date(2024, 4, 1), date(2024, 6, 30)), (date(2024, 7, 1), date(2024, 9, 30))])
    assert [(a.count(), b.count()) for a, b, _ in folds] == [(3, 3), (6, 3)]
    for blocks in ([(date(2024, 4, 1), date(2024, 6, 30)), (date(2024, 6, 30), date(2024, 9, 30))], [(date(2024, 1, 1), date(2024, 2, 1))], [(date(2025, 1, 1), date(2025, 2, 1))]):
        with pytest.raises(ValueError):
            models.dated_folds(rows, "d", blocks)
    assert models.last_months(rows, "d", 2) == [(date(2024, 11, 1), date(2024, 11, 30)), (date(2024, 12, 1), date(2024, 12, 31))]


def test_trees_learn_what_a_line_cannot(spark):
    rows = spark.createDataFrame([(float(a), float(a % 3), "k" if a % 2 else None, int(3 <= a <= 6), i) for i in range(30) for a in range(10)], "a double, b double, c string, y int, i int")
    x = models.indexed(rows, ["a", "b"], ["c"])
    out = models.probabilities(models.boosted(rows.withColumn("features", x), rounds=10, depth=3), rows.withColumn("features", x))
    assert out.where((F.col("p") > 0.5).cast("int") != F.col("y")).count() == 0
    unseen = spark.createDataFrame([(None, 1.0, "new")], "a double, b double, c string").select(x.alias("f")).first().f.toArray().tolist()
    assert unseen == [-1e9, 1.0, 1.0]  # one more category, as nominal ones have no values below 0


def test_sigmoid_calibration_mends_a_skewed_chance(spark):
    rows = [(int(k % 10 < 10 * p), p**2) for p in (0.2, 0.5, 0.8) for k in range(200)]
    oof = spark.createDataFrame(rows, "y int, p double")
    out = {round(r.q, 2): r.p for r in models.calibrated(oof, oof.select("y", "p", F.col("p").alias("q"))).select("q", "p").distinct().collect()}
    assert out[0.25] == pytest.approx(0.5, abs=0.06) and out[0.04] < out[0.25] < out[0.64]


def test_bins_of_ranges_are_those_of_windows(spark):
    x = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).alias("v"), F.col("id"))
    x = x.union(spark.createDataFrame([(None, 5, 1000), (None, 5, 1001)], "g long, v long, id long"))
    ranged = {r.id: r.bin for r in R.with_rank_bins(x, "v", ["g"], 4).collect()}
    plain = {r.id: r.b for r in x.withColumn("b", R.rank_percent_bin("v", ["g"], 4)).collect()}
    assert ranged == plain and len(ranged) == 502
    equal = {r.id: r.bin for r in R.with_equal_bins(x, ["v", "id"], ["g"], 6).collect()}
    assert equal == {r.id: r.b for r in x.withColumn("b", R.equal_count_bin(["v", "id"], ["g"], 6)).collect()}


def test_tied_places_two_ways(spark):
    rows = [(g, r) for g, ranks in enumerate([(1, 2, 3), (1, 1, 3), (1, 2, 2), (1, 1, 1), (1, 2, 3, 3), (1, 1)]) for r in ranks]
    frame = spark.createDataFrame(rows, "g int, r int")
    a = {(r.g, r.pool): r.expected for r in marts.tied_counts(frame, "g", "r").collect()}
    assert a == {(r.g, r.pool): r.paid for r in marts.winning_sets(frame, "g", "r").collect()}
    assert [a[g, "QNL"] for g in range(6)] == [1, 1, 2, 3, 1, 1] and [a[g, "TRI"] for g in range(5)] == [1, 2, 2, 0, 2] and a[4, "QPL"] == 6


def test_last_events_and_values_by_day(spark):
    """Arrays of the last events and of the last values that are there, against a search through all earlier events."""
    import numpy as np

    random = np.random.default_rng(8)
    rows = []
    for i in range(900):
        member = None if random.random() < 0.03 else ("hot" if random.random() < 0.5 else f"m{random.integers(8)}")
        rows.append((i, member, date(2024, 1, 1) + timedelta(days=int(random.integers(0, 60))), None if random.random() < 0.6 else float(random.integers(0, 99)), bool(random.random() < 0.4)))
    frame = spark.createDataFrame(rows, "id int, member string, d date, v double, hit boolean").repartition(5)
    out = {(r.member, r.d): r for r in H.prior_days(frame, ["member"], "d", {"hits": ("sum", F.col("hit").cast("int"))}, (4, ["id"], ["id", "hit"]), {"v": 3}).collect()}
    assert out.keys() == {(m, d) for _, m, d, _, _ in rows if m is not None}
    for (m, d), r in out.items():
        earlier = sorted(((x[2], x[0], x) for x in rows if x[1] == m and x[2] < d), reverse=True)
        assert [(x.id, x.hit) for x in r["last"]] == [(x[0], x[4]) for _, _, x in earlier[:4]]
        assert r.latest_v == [x[3] for _, _, x in earlier if x[3] is not None][:3]
        assert (r.n_prior, r.hits) == (len(earlier), sum(x[4] for _, _, x in earlier))


def test_statistics_of_arrays(spark):
    import numpy as np

    values = [[3.0, 1.0, 2.0, 5.0], [2.0], [], [4.0, 4.0], None]
    rows = spark.createDataFrame([(v,) for v in values], "a array<double>")
    out = rows.select(C.total(F.col("a")).alias("t"), C.mean(F.col("a")).alias("m"), C.middle(F.col("a")).alias("q"), C.sample_std(F.col("a")).alias("s"), C.slope_to_latest(F.col("a")).alias("k")).collect()
    for v, r in zip(values[:4], out, strict=False):
        assert r.t == sum(v) and r.m == (np.mean(v) if v else None) and r.q == (np.median(v) if v else None)
        assert r.s == (pytest.approx(np.std(v, ddof=1)) if len(v) > 1 else None)
    assert out[0].k == pytest.approx(np.polyfit([-1, -2, -3, -4], values[0], 1)[0]) and out[4].m is None and out[4].q is None


def test_exact_quantiles_of_any_group(spark):
    import numpy as np

    random = np.random.default_rng(3)
    values = [(None if k == 2 else int(k), float(v)) for k, v in zip(random.integers(0, 4, 700), random.integers(0, 90, 700) / 4, strict=True)] + [(7, None), (8, 1.5)]
    out = {r.k: (r.q0, r.q1, r.q2) for r in R.exact_quantiles(spark.createDataFrame(values, "k int, v double"), "v", ["k"], [0.1, 0.5, 0.95]).collect()}
    groups = {}
    for k, v in values:
        groups.setdefault(k, []).append(v)
    del groups[7]
    assert out.keys() == groups.keys()
    for k, own in groups.items():
        assert out[k] == pytest.approx(tuple(np.quantile(own, [0.1, 0.5, 0.95])))


@pytest.mark.parametrize("large", [1000, 25_000, 100_000])
def test_exact_quantiles_of_large_groups(spark, monkeypatch, large):
    """Groups much larger than a bracket: skewed, in steps, with ties around every quantile, and with one value only."""
    import numpy as np

    monkeypatch.setattr(R, "LARGE", large)  # all groups, some, none with brackets
    random = np.random.default_rng(5)
    groups = {"skewed": random.lognormal(0, 3, 40_000), "steps": random.integers(0, 7, 30_000) * 1.0, "one": np.full(9_000, 2.5), "wide": random.normal(0, 1e12, 20_001), "few": np.array([3.0, -1.0])}
    at = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    rows = spark.createDataFrame([(k, float(v)) for k, own in groups.items() for v in own], "k string, v double").repartition(7)
    plan = R.exact_quantiles(rows, "v", ["k"], at)
    out = {r.k: [r[f"q{i}"] for i in range(len(at))] for r in plan.collect()}
    assert out.keys() == groups.keys() and all(out[k] == pytest.approx(np.quantile(own, at), rel=1e-12, abs=1e-12) for k, own in groups.items())
    assert R.exact_quantiles(rows, "v", [], [0.5]).first().q0 == pytest.approx(np.median(np.concatenate([*groups.values()])))
    assert R.exact_quantiles(rows.where("false"), "v", ["k"], [0.5]).count() == 0


def test_pareto_front_in_blocks(spark):
    import numpy as np

    random = np.random.default_rng(4)
    x = random.integers(0, 60, (400, 3)).astype(float)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000, None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k int, a double, b double, c double")
    z = x * [1, 1, -1]
    front = {i for i in range(400) if not ((z >= z[i]).all(axis=1) & (z > z[i]).any(axis=1)).any()} | {1000}
    for block in (4096, 32):
        out = marts.pareto_front(frame, "k", ["a", "b"], ["c"], block).collect()
        assert len(out) == 401 and {r.k for r in out if r.on_front} == front
