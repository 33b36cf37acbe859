"""Scores of a fixed formula evaluated as predictions, period by period."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import evaluate as E
from pastmark.operators import relative as R
from pastmark.operators.state import saved
from pastmark.plans.newton import newton
from pastmark.plans.base import PREDS, Registry, preds, rounded

register = Registry()
LOSS = PREDS + """,
cl AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM preds),
l AS (SELECT *, -(y * ln(q) + (1 - y) * ln(1 - q)) AS ll, (p - y) * (p - y) AS br FROM cl),
g AS (SELECT period, grp, count(*) AS n, avg(ll) AS log_loss, avg(br) AS brier FROM l GROUP BY 1, 2)
"""


@register(f"WITH {LOSS} SELECT period, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(log_loss), 8) AS macro_log_loss, round(avg(brier), 8) AS macro_brier, round(sum(log_loss * n) / sum(n), 8) AS micro_log_loss, round(sum(brier * n) / sum(n), 8) AS micro_brier FROM g GROUP BY 1")
def macro_losses(spark, sf_dir):
    return rounded(E.macro_losses(preds(spark, sf_dir), "grp", ["period"]), 8)


@register(f"WITH {LOSS} SELECT grp, n, round(log_loss, 7) AS log_loss, round(brier, 7) AS brier FROM g")
def group_losses(spark, sf_dir):
    return rounded(E.group_losses(preds(spark, sf_dir), ["grp"]), 7)


@register(f"""WITH {PREDS}, b AS (SELECT period, y, p, row_number() OVER (PARTITION BY period ORDER BY p, grp, member) - 1 AS pos, count(*) OVER (PARTITION BY period) AS n FROM preds),
c AS (SELECT *, CAST(greatest(1, ceil(pos * 10 / greatest(n - 1, 1))) AS INTEGER) AS bin FROM b) SELECT period, bin, count(*) AS n_rows, round(avg(p), 7) AS mean_p, round(avg(y), 7) AS rate FROM c GROUP BY 1, 2""")
def calibration_bins(spark, sf_dir):
    x = R.with_equal_bins(preds(spark, sf_dir), ["p", "grp", "member"], ["period"], 10)
    return rounded(x.groupBy("period", "bin").agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate")), 7)


@register(f"WITH {PREDS} SELECT CAST(floor(p * 10) AS INTEGER) AS bin, count(*) AS n_rows, round(avg(y), 7) AS rate FROM preds WHERE p >= 0 AND p < 1 GROUP BY 1")
def probability_bins(spark, sf_dir):
    x = preds(spark, sf_dir).withColumn("bin", C.probability_bin(F.col("p"))).where("bin is not null")
    return rounded(x.groupBy("bin").agg(F.count("*").alias("n_rows"), F.avg("y").alias("rate")), 7)


THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


@register(f"""WITH {PREDS}, t AS (SELECT CAST(unnest({list(THRESHOLDS)}) AS DOUBLE) AS threshold), c AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn FROM preds, t GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1, round(tn / nullif(tn + fp, 0), 8) AS specificity FROM c""")
def threshold_confusion(spark, sf_dir):
    return E.confusion(preds(spark, sf_dir), THRESHOLDS).select("threshold", "tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("precision", "recall", "f1", "specificity")))


CURVE = PREDS + ", n AS (SELECT period, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM preds GROUP BY 1, 2), cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM n WINDOW w AS (PARTITION BY period ORDER BY p DESC))"


@register(f"""WITH {PREDS}, n AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM preds GROUP BY 1), c AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np FROM n WINDOW w AS (ORDER BY p DESC))
SELECT p AS threshold, round(2 * tp / (tp + fp + np), 12) AS f1 FROM c ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def max_f1(spark, sf_dir):
    return E.best_f1(preds(spark, sf_dir))


@register(f"""WITH {CURVE} SELECT period, round(sum(neg * (tp - pos) + pos * neg / 2) / (sum(pos) * sum(neg)), 8) AS roc_auc, round(sum(pos * tp / nullif(tp + fp, 0)) / sum(pos), 8) AS average_precision, round(sum(pos) / (sum(pos) + sum(neg)), 8) AS prevalence,
round(sum(pos * tp / nullif(tp + fp, 0)) / sum(pos) / (sum(pos) / (sum(pos) + sum(neg))), 8) AS lift FROM cv GROUP BY 1""")
def auc_ap(spark, sf_dir):
    return rounded(E.auc_ap(preds(spark, sf_dir), ["period"]), 8)


RANKED = PREDS + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, member) AS rank FROM preds), h AS (SELECT *, count(*) FILTER (y = 1) OVER (PARTITION BY grp ORDER BY rank) AS hits FROM r)"


@register(f"""WITH {RANKED}, k AS (SELECT unnest([1, 2, 3]) AS k), g AS (SELECT grp, k, sum(y) AS pos, count(*) FILTER (rank <= k AND y = 1) AS h, count(*) FILTER (rank <= k) AS n FROM r, k GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_groups, round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 8) AS any_hit, round(avg(h), 8) AS mean_hits, round(sum(h) / sum(n), 8) AS precision, round(sum(h) / sum(pos), 8) AS micro_recall, round(avg(h / nullif(pos, 0)), 8) AS macro_recall FROM g GROUP BY 1""")
def topk_hits(spark, sf_dir):
    return rounded(E.topk_hits(preds(spark, sf_dir), "grp", "member"), 8)


@register(f"""WITH {RANKED}, g AS (SELECT grp, count(*) FILTER (y = 1) AS pos, sum(CASE WHEN y = 1 AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (y = 1 AND rank = 1) AS top1, count(*) FILTER (y = 1 AND rank <= 3) AS top3, avg(rank) FILTER (y = 1) AS mr, avg(hits / rank) FILTER (y = 1) AS ap FROM h GROUP BY 1)
SELECT count(*) AS n_groups, round(avg(dcg / CASE pos WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END), 8) AS ndcg3, round(avg(top1 / pos), 8) AS recall1, round(avg(top3 / pos), 8) AS recall3, round(avg(top1), 8) AS top1, round(avg(CASE WHEN top3 > 0 THEN 1 ELSE 0 END), 8) AS any3, round(avg(mr), 8) AS mean_positive_rank, round(avg(ap), 8) AS mean_ap FROM g WHERE pos > 0""")
def ranking_metrics(spark, sf_dir):
    return rounded(E.ranking_metrics(preds(spark, sf_dir), "grp", "member"), 8)


DRIFT = ("rating", "t", "weight")


@register(f"""WITH {PREDS}, x AS (SELECT period, unnest([{", ".join(f"{{'m': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in DRIFT)}]) AS z FROM preds),
q AS (SELECT z.m AS metric, {", ".join(f"count(*) FILTER (period = '{p}') AS {n}_n_rows, round(count(*) FILTER (period = '{p}' AND z.v IS NULL) / count(*) FILTER (period = '{p}'), 5) AS {n}_null_rate, avg(z.v) FILTER (period = '{p}') AS {n}_mean, quantile_cont(z.v, 0.1) FILTER (period = '{p}') AS {n}_p10, quantile_cont(z.v, 0.5) FILTER (period = '{p}') AS {n}_p50, quantile_cont(z.v, 0.9) FILTER (period = '{p}') AS {n}_p90" for n, p in (("first", "STABLE"), ("second", "SHIFTED")))} FROM x GROUP BY 1)
SELECT metric, {", ".join(f"{n}_n_rows, {n}_null_rate, round({n}_mean, 5) AS {n}_mean, round({n}_p10, 5) AS {n}_p10, round({n}_p50, 5) AS {n}_p50, round({n}_p90, 5) AS {n}_p90" for n in ("first", "second"))}, round(second_mean - first_mean, 5) AS mean_change, round(second_p50 - first_p50, 5) AS p50_change FROM q""")
def numeric_drift(spark, sf_dir):
    return rounded(E.numeric_drift(preds(spark, sf_dir), "period", "STABLE", "SHIFTED", DRIFT), 5)


@register(f"""WITH {PREDS}, n AS (SELECT pool, count(*) FILTER (period = 'STABLE') AS a, count(*) FILTER (period = 'SHIFTED') AS b FROM preds GROUP BY 1), s AS (SELECT pool, a / sum(a) OVER () AS f, b / sum(b) OVER () AS s FROM n)
SELECT pool, round(f, 8) AS first_share, round(s, 8) AS second_share, round(100 * (s - f), 8) AS points FROM s""")
def category_drift(spark, sf_dir):
    return rounded(E.category_drift(preds(spark, sf_dir), "period", "STABLE", "SHIFTED", "pool"), 8)


@register(f"""WITH {LOSS}, sz AS (SELECT period, n AS seg, brier FROM g), n AS (SELECT seg, count(*) FILTER (period = 'STABLE') AS n0, count(*) FILTER (period = 'SHIFTED') AS n1, avg(brier) FILTER (period = 'STABLE') AS m0, avg(brier) FILTER (period = 'SHIFTED') AS m1 FROM sz GROUP BY 1),
s AS (SELECT *, n0 / sum(n0) FILTER (n0 > 0 AND n1 > 0) OVER () AS s0, n1 / sum(n1) FILTER (n0 > 0 AND n1 > 0) OVER () AS s1, n0 > 0 AND n1 > 0 AS b FROM n),
f AS (SELECT sum(n0 * m0) / sum(n0) AS first_mean, sum(n1 * m1) / sum(n1) AS second_mean, sum(0.5 * (s1 - s0) * (m0 + m1)) FILTER (b) AS composition, sum(0.5 * (m1 - m0) * (s0 + s1)) FILTER (b) AS within, sum(s0 * m0) FILTER (b) AS c0, sum(s1 * m1) FILTER (b) AS c1 FROM s)
SELECT round(first_mean, 8) AS first_mean, round(second_mean, 8) AS second_mean, round(composition, 8) AS composition, round(within, 8) AS within, round(second_mean - first_mean, 8) AS total_change, round(c0 - first_mean, 8) AS first_only, round(second_mean - c1, 8) AS second_only, round(abs((second_mean - first_mean) - (composition + within + (c0 - first_mean) + (second_mean - c1))), 8) AS residual FROM f""")
def mix_decomposition(spark, sf_dir):
    g = E.group_losses(preds(spark, sf_dir), ["period", "grp"])
    out = rounded(E.mix_decomposition(g, "n", "period", "STABLE", "SHIFTED", "brier"), 8)
    return out.withColumn("residual", F.abs("residual"))


FOLDS = PREDS + ", f AS (SELECT *, year(d) AS fold, y - p AS res, (y - p) * (y - p) AS sq FROM preds)"


def _avg_rank_sql(x, part, src, name, k):
    return f"CASE WHEN min({x}) OVER (PARTITION BY {part}) < max({x}) OVER (PARTITION BY {part}) THEN CAST(least(ceil((rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}) * {k}), {k}) AS INTEGER) END AS {name}"


def folds(spark, sf_dir):
    return preds(spark, sf_dir).withColumn("fold", F.year("d").cast("long")).withColumn("res", F.col("y") - F.col("p")).withColumn("sq", F.col("res") * F.col("res"))


#: The features of a prediction's row that residuals are looked at by.
BINNED = ("t", "rating", "weight", "dist", "venue")
LONG = FOLDS + f""", u AS (SELECT fold, grp, member, y, p, res, sq, z.m AS feature, z.v AS v FROM (SELECT *, unnest([{", ".join(f"{{'m': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in BINNED)}]) AS z FROM f))"""


def _long_bins(spark, sf_dir, k):
    """(fold, grp, member, y, p, res, sq, feature, value, bin): a row per feature."""
    x = folds(spark, sf_dir).select("fold", "grp", "member", "y", "p", "res", "sq", *(F.col(c).cast("double").alias(c) for c in BINNED))
    long = x.unpivot(["fold", "grp", "member", "y", "p", "res", "sq"], list(BINNED), "feature", "value")
    return R.with_rank_bins(long, "value", ["fold", "feature"], k)


@register(f"WITH {LONG}, b AS (SELECT *, {_avg_rank_sql('v', 'fold, feature', 'u', 'bin', 5)} FROM u) SELECT fold, feature, bin, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, round(avg(y), 7) AS rate, round(avg(p), 7) AS mean_p, round(avg(res), 7) AS mean_residual, round(avg(sq), 7) AS mean_brier, min(v) AS lowest, round(median(v), 4) AS middle, max(v) AS highest FROM b WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
def residual_bins(spark, sf_dir):
    """Residuals by fifths of each feature."""
    x = _long_bins(spark, sf_dir, 5).where("bin is not null")
    out = x.groupBy("fold", "feature", "bin").agg(F.count("*").alias("n_rows"), F.countDistinct("grp").alias("n_groups"), F.avg("y").alias("rate"), F.avg("p").alias("mean_p"), F.avg("res").alias("mean_residual"), F.avg("sq").alias("mean_brier"), F.min("value").alias("lowest"), F.round(F.median("value"), 4).alias("middle"), F.max("value").alias("highest"))
    return rounded(out, 7)


CELLS = f"""b AS (SELECT *, {_avg_rank_sql('v', 'fold, feature', 'u', 'bin', 3)} FROM u), v AS (SELECT l.fold, l.feature AS left_feature, r.feature AS right_feature, l.bin AS left_bin, r.bin AS right_bin, l.res FROM b l JOIN b r ON l.grp = r.grp AND l.member = r.member AND l.feature < r.feature WHERE l.bin IS NOT NULL AND r.bin IS NOT NULL),
c AS (SELECT fold, left_feature, right_feature, left_bin, right_bin, count(*) AS n_rows, sum(res) AS s FROM v GROUP BY ALL),
cells AS (SELECT *, s / n_rows AS m, sum(s) OVER l / sum(n_rows) OVER l + sum(s) OVER r / sum(n_rows) OVER r - sum(s) OVER w / sum(n_rows) OVER w AS additive FROM c WINDOW w AS (PARTITION BY fold, left_feature, right_feature), l AS (PARTITION BY fold, left_feature, right_feature, left_bin), r AS (PARTITION BY fold, left_feature, right_feature, right_bin))"""


def _cells(spark, sf_dir):
    wide = _long_bins(spark, sf_dir, 3).groupBy("fold", "grp", "member").pivot("feature", list(BINNED)).agg(F.first("bin")).join(folds(spark, sf_dir).select("grp", "member", "res"), ["grp", "member"])
    pairs = [(a, b) for a in sorted(BINNED) for b in sorted(BINNED) if a < b]
    x = wide.select("fold", "res", F.explode(F.array(*(F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), F.col(a).alias("left_bin"), F.col(b).alias("right_bin")) for a, b in pairs))).alias("x")).select("fold", "res", "x.*")
    c = x.where("left_bin is not null and right_bin is not null").groupBy("fold", "left_feature", "right_feature", "left_bin", "right_bin").agg(F.count("*").alias("n_rows"), F.sum("res").alias("s"))
    pair = ["fold", "left_feature", "right_feature"]
    mean = lambda *by: F.sum("s").over(Window.partitionBy(*pair, *by)) / F.sum("n_rows").over(Window.partitionBy(*pair, *by))
    return c.withColumn("mean_residual", F.col("s") / F.col("n_rows")).withColumn("additive", mean("left_bin") + mean("right_bin") - mean()).drop("s")


@register(f"WITH {LONG}, {CELLS} SELECT fold, left_feature, right_feature, left_bin, right_bin, n_rows, round(m, 7) AS mean_residual, round(additive, 7) AS additive, round(m - additive, 7) AS interaction FROM cells")
def residual_cells(spark, sf_dir):
    """All pairs of features: what their own bins do not explain. From sums over the nine cells of a fold and pair."""
    return rounded(_cells(spark, sf_dir).withColumn("interaction", F.col("mean_residual") - F.col("additive")), 7)


@register(f"""WITH {FOLDS}, g AS (SELECT fold, grp, count(*) AS size, sum(p) AS ps, sum(y) AS hits, max(p) - min(p) AS gap, avg(sq) AS br, avg(res) AS mr FROM f GROUP BY 1, 2)
SELECT fold, size, count(*) AS n_groups, round(avg(ps), 7) AS mean_predicted, round(median(ps), 7) AS median_predicted, round(avg(hits), 7) AS mean_hits, round(median(hits), 7) AS median_hits, round(avg(br), 7) AS mean_brier, round(avg(mr), 7) AS mean_residual FROM g GROUP BY 1, 2""")
def group_structure(spark, sf_dir):
    g = folds(spark, sf_dir).groupBy("fold", "grp").agg(F.count("*").alias("size"), F.sum("p").alias("ps"), F.sum("y").alias("hits"), F.avg("sq").alias("br"), F.avg("res").alias("mr"))
    return rounded(g.groupBy("fold", "size").agg(F.count("*").alias("n_groups"), F.avg("ps").alias("mean_predicted"), F.median("ps").alias("median_predicted"), F.avg("hits").alias("mean_hits"), F.median("hits").alias("median_hits"), F.avg("br").alias("mean_brier"), F.avg("mr").alias("mean_residual")), 7)


GAPS = FOLDS + """, gp AS (SELECT fold, grp, max(p) - min(p) AS gap, sum(p) AS ps, sum(y) AS hits, avg(sq) AS br, avg(res) AS mr, avg((0.2 + 3 * weight - y) * (0.2 + 3 * weight - y)) AS br2, sum(0.2 + 3 * weight) AS ps2 FROM f GROUP BY 1, 2)"""


def _gaps(spark, sf_dir):
    other = 0.2 + 3 * F.col("weight")
    g = folds(spark, sf_dir).groupBy("fold", "grp").agg((F.max("p") - F.min("p")).alias("gap"), F.sum("p").alias("ps"), F.sum("y").alias("hits"), F.avg("sq").alias("br"), F.avg("res").alias("mr"), F.avg((other - F.col("y")) * (other - F.col("y"))).alias("br2"), F.sum(other).alias("ps2"))
    return R.with_rank_bins(g.withColumn("gap", F.round("gap", 9)), "gap", ["fold"], 4, flat=False)


def _gap_bin_sql():
    return "CAST(least(ceil((rank() OVER (PARTITION BY fold ORDER BY gap) + (count(*) OVER (PARTITION BY fold, gap) - 1) / 2.0) / count(*) OVER (PARTITION BY fold) * 4), 4) AS INTEGER) AS bin"


@register(f"WITH {GAPS}, r AS (SELECT * REPLACE (round(gap, 9) AS gap) FROM gp), b AS (SELECT *, {_gap_bin_sql()} FROM r) SELECT fold, bin, count(*) AS n_groups, round(median(gap), 7) AS median_gap, round(avg(ps), 7) AS mean_predicted, round(avg(hits), 7) AS mean_hits, round(avg(br), 7) AS mean_brier, round(avg(mr), 7) AS mean_residual FROM b GROUP BY 1, 2")
def gap_structure(spark, sf_dir):
    """Groups by the distance between their highest and lowest chance, in quarters of a fold."""
    out = _gaps(spark, sf_dir).groupBy("fold", "bin").agg(F.count("*").alias("n_groups"), F.median("gap").alias("median_gap"), F.avg("ps").alias("mean_predicted"), F.avg("hits").alias("mean_hits"), F.avg("br").alias("mean_brier"), F.avg("mr").alias("mean_residual"))
    return rounded(out, 7)


@register(f"WITH {GAPS}, r AS (SELECT * REPLACE (round(gap, 9) AS gap) FROM gp), b AS (SELECT *, {_gap_bin_sql()} FROM r) SELECT fold, bin, round(avg(br), 7) AS brier_first, round(avg(br2), 7) AS brier_second, round(avg(ps), 7) AS predicted_first, round(avg(ps2), 7) AS predicted_second, round(avg(br2) - avg(br), 7) AS brier_change, round(avg(ps2) - avg(ps), 7) AS predicted_change FROM b GROUP BY 1, 2")
def model_comparison(spark, sf_dir):
    """Two models by the gap quarters of the first: a row per model, then models as columns and their difference."""
    g = _gaps(spark, sf_dir)
    model = lambda name, br, ps: g.select("fold", "bin", F.lit(name).alias("model"), F.col(br).alias("brier"), F.col(ps).alias("predicted"))
    long = model("first", "br", "ps").unionByName(model("second", "br2", "ps2"))
    wide = long.groupBy("fold", "bin").pivot("model", ["first", "second"]).agg(F.avg("brier").alias("brier"), F.avg("predicted").alias("predicted"))
    names = [F.col(f"{m}_{x}").alias(f"{x}_{m}") for x in ("brier", "predicted") for m in ("first", "second")]
    change = lambda x: (F.col(f"second_{x}") - F.col(f"first_{x}")).alias(f"{x}_change")
    return rounded(wide.select("fold", "bin", *names, change("brier"), change("predicted")), 7)


@register(f"""WITH {LOSS} SELECT period, metric, stored, again, round(abs(stored - again), 8) AS difference, abs(stored - again) <= 1e-9 AS same FROM (SELECT period, unnest(['brier', 'log_loss']) AS metric, unnest([round(avg(brier) + CASE WHEN period = 'SHIFTED' THEN 0.001 ELSE 0 END, 8), round(avg(log_loss), 8)]) AS stored, unnest([round(avg(brier), 8), round(avg(log_loss), 8)]) AS again FROM g GROUP BY 1)""")
def reproduction_check(spark, sf_dir):
    """Stored metrics, one of them changed, against those found again from the predictions."""
    again = E.macro_losses(preds(spark, sf_dir), "grp", ["period"]).select("period", F.col("macro_brier").alias("brier"), F.col("macro_log_loss").alias("log_loss"))
    w = F.sum("w").over(Window.partitionBy("period"))  # the same means another way: rows weigh one over the size of their group
    x = preds(spark, sf_dir).withColumn("w", 1 / F.count("*").over(Window.partitionBy("period", "grp"))).withColumn("total", w)
    stored = x.groupBy("period").agg(F.sum(C.brier(F.col("y"), F.col("p")) * F.col("w") / F.col("total")).alias("brier"), F.sum(C.log_loss(F.col("y").cast("double"), F.col("p")) * F.col("w") / F.col("total")).alias("log_loss"))
    stored = stored.withColumn("brier", F.col("brier") + F.when(F.col("period") == "SHIFTED", 0.001).otherwise(0.0))
    return rounded(E.reproduced(stored, again, ["period"], ["brier", "log_loss"]), 8)


@register(f"""WITH {RANKED}, k AS (SELECT unnest([1, 2, 3]) AS k), g AS (SELECT grp, k, count(*) FILTER (rank <= k AND y = 1) AS hits FROM r, k GROUP BY 1, 2), n AS (SELECT k, hits, count(*) AS n_groups FROM g GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS k, hits, n_groups, round(n_groups / sum(n_groups) OVER (PARTITION BY k), 8) AS share FROM n""")
def topk_hit_distribution(spark, sf_dir):
    """In how many groups the first k hold 0, 1, .. hits."""
    return rounded(E.hit_distribution(preds(spark, sf_dir), "grp", "member"), 8)


@register(f"""WITH {PREDS}, x AS (SELECT DISTINCT period, grp, pool FROM preds), n AS (SELECT pool, count(*) FILTER (period = 'STABLE') AS a, count(*) FILTER (period = 'SHIFTED') AS b FROM x GROUP BY 1), s AS (SELECT pool, a / sum(a) OVER () AS f, b / sum(b) OVER () AS s FROM n)
SELECT pool, round(f, 8) AS first_share, round(s, 8) AS second_share, round(100 * (s - f), 8) AS points FROM s""")
def category_drift_of_groups(spark, sf_dir):
    """Shares of groups, not of their rows."""
    x = preds(spark, sf_dir).select("period", "grp", "pool").distinct()
    return rounded(E.category_drift(x, "period", "STABLE", "SHIFTED", "pool"), 8)


@register(f"""WITH {LOSS}, s AS (SELECT period, CASE WHEN n <= 3 THEN '<=3' WHEN n <= 5 THEN '4-5' ELSE '6+' END AS segment, n, log_loss, brier FROM g) SELECT period, segment, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY period), 8) AS share, round(avg(log_loss), 8) AS mean_log_loss, round(avg(brier), 8) AS mean_brier FROM s GROUP BY 1, 2""")
def segment_shares(spark, sf_dir):
    """Groups by size band and period: shares and losses."""
    g = E.group_losses(preds(spark, sf_dir), ["period", "grp"]).withColumn("segment", C.band(F.col("n"), [3, 5]))
    out = g.groupBy("period", "segment").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.avg("log_loss").alias("mean_log_loss"), F.avg("brier").alias("mean_brier"))
    return rounded(out.withColumn("share", F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy("period"))), 8)  # a row per band and period


def _stability_sql(source, pattern, place, least):
    both = " AND ".join(f"a.{c} = b.{c}" for c in (*pattern, *place))
    by = ", ".join(pattern)
    return f"""SELECT s.*, c.r AS median_correlation, n.common_cells, n.same_sign_cells FROM (SELECT {by}, count(*) AS n_folds, median(spread) AS median_spread FROM (SELECT {by}, fold, max(x) - min(x) AS spread FROM {source} GROUP BY {by}, fold) GROUP BY {by}) s
LEFT JOIN (SELECT {by}, median(r) AS r FROM (SELECT {", ".join(f"a.{c}" for c in pattern)}, corr(a.x, b.x) AS r FROM {source} a JOIN {source} b ON {both} AND a.fold < b.fold GROUP BY {", ".join(f"a.{c}" for c in pattern)}, a.fold, b.fold HAVING count(*) >= {least}) WHERE NOT isnan(r) GROUP BY {by}) c USING ({by})
JOIN (SELECT {by}, count(*) FILTER (k = all_folds) AS common_cells, count(*) FILTER (k = all_folds AND (lo > 0 OR hi < 0)) AS same_sign_cells FROM (SELECT {by}, {", ".join(place)}, count(*) AS k, min(x) AS lo, max(x) AS hi FROM {source} GROUP BY ALL) JOIN (SELECT {by}, count(DISTINCT fold) AS all_folds FROM {source} GROUP BY ALL) USING ({by}) GROUP BY {by}) n USING ({by})"""


LEAST_ROWS = 100


def _patterns_sql():
    bins = f"b5 AS (SELECT *, {_avg_rank_sql('v', 'fold, feature', 'u', 'bin', 5)} FROM u), m1 AS (SELECT fold, feature, bin, avg(res) AS x FROM b5 WHERE bin IS NOT NULL GROUP BY 1, 2, 3)"
    ends = "d1 AS (SELECT feature, greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) AS same_direction FROM (SELECT feature, fold, arg_max(x, bin) - arg_min(x, bin) AS d FROM m1 GROUP BY 1, 2) GROUP BY 1)"
    cells = f"m2 AS (SELECT fold, left_feature, right_feature, left_bin, right_bin, m - additive AS x FROM cells WHERE n_rows >= {LEAST_ROWS})"
    columns = "n_folds, round(median_spread, 7) AS median_spread, round(median_correlation, 5) AS median_correlation, common_cells, same_sign_cells"
    return f"""WITH {LONG}, {CELLS}, {bins}, {ends}, {cells}, alone AS ({_stability_sql("m1", ["feature"], ["bin"], 2)}), paired AS ({_stability_sql("m2", ["left_feature", "right_feature"], ["left_bin", "right_bin"], 3)})
SELECT feature AS left_feature, NULL AS right_feature, CAST(n_folds AS INTEGER) AS n_folds, {columns.split(", ", 1)[1]}, same_direction FROM alone JOIN d1 USING (feature) UNION ALL SELECT left_feature, right_feature, CAST(n_folds AS INTEGER), {columns.split(", ", 1)[1]}, NULL FROM paired"""


@register(_patterns_sql())
def pattern_stability(spark, sf_dir):
    """Residual patterns over fifths of each feature, and interactions over cells of two features with at least 100 rows:
    spread within a fold, correlation between folds, direction and sign."""
    c = F.col
    bins = saved(_long_bins(spark, sf_dir, 5).where("bin is not null").groupBy("fold", "feature", "bin").agg(F.avg("res").alias("x")))
    cells = saved(_cells(spark, sf_dir).where(c("n_rows") >= LEAST_ROWS).withColumn("x", c("mean_residual") - c("additive")))
    years = sorted(r[0] for r in bins.select("fold").distinct().collect())  # one row a fold
    one = E.stability(bins, ["feature"], ["bin"], "fold", "x", years, 2).join(E.directions(bins, ["feature"], "bin", "fold", "x"), "feature")
    two = E.stability(cells, ["left_feature", "right_feature"], ["left_bin", "right_bin"], "fold", "x", years, 3)
    both = one.withColumnRenamed("feature", "left_feature").unionByName(two, allowMissingColumns=True)
    return both.select("left_feature", "right_feature", "n_folds", F.round("median_spread", 7).alias("median_spread"), F.round("median_correlation", 5).alias("median_correlation"), "common_cells", "same_sign_cells", "same_direction")


@register(f"""WITH {LOSS}, i AS (SELECT grp, brier, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM g WHERE period = 'SHIFTED'),
s AS (SELECT unnest(generate_series(0, 99)) AS draw), d AS (SELECT draw, slot, CAST('0x' || substr(md5(draw || ':' || slot), 1, 8) AS BIGINT) % (SELECT max(n) FROM i) AS i FROM s, (SELECT unnest(generate_series(0, (SELECT max(n) - 1 FROM i))) AS slot)),
m AS (SELECT draw, avg(brier) AS mean FROM d JOIN i USING (i) GROUP BY 1)
SELECT count(*) AS draws, {", ".join(f"round(quantile_cont(mean, {q}), 7) AS q{n}" for n, q in (("025", 0.025), ("50", 0.5), ("975", 0.975)))} FROM m""")
def bootstrap_quantiles(spark, sf_dir):
    """100 draws of all late groups by a hash that SQL has too. The whole job is `bootstrap_stability`."""
    g = E.group_losses(preds(spark, sf_dir).where("period = 'SHIFTED'"), ["grp"])
    i = E.numbered(g, "grp").select("i", "brier")
    n = i.count()
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "slot")), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    m = E.bootstrap(i, "i", "brier", n, 100, drawn)
    return m.agg(F.count("*").alias("draws"), *(F.round(F.percentile("mean", q), 7).alias(f"q{k}") for k, q in (("025", 0.025), ("50", 0.5), ("975", 0.975))))


DRAWS = 10_000


@register()
def bootstrap_stability(spark, sf_dir):
    """No SQL: random draws. `late`: all late groups, drawn from themselves. `month`: as many stable groups as a late
    month has, drawn from all stable ones, against that month's mean. `block`: the same for three months in a row, from
    the first late month on, as the mean of their means. A draw picks the same groups for both losses."""
    losses, late = ["log_loss", "brier"], F.col("period") == "SHIFTED"
    p = preds(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM"))
    g = saved(E.group_losses(p, ["period", "month", "grp"]).select("period", "month", "grp", *losses))
    months = g.where(late).groupBy("month").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in losses)).orderBy("month").collect()
    number = lambda m: 12 * int(m[:4]) + int(m[5:])
    block = {m.month: f"{b:02d}" for m in months for b in [(number(m.month) - number(months[0].month)) // 3]}
    whole = g.where(late).agg(F.lit("late").alias("kind"), F.lit("all").alias("sample"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in losses))
    total = sum(m.n for m in months)

    actual = spark.createDataFrame([("month", m.month, block[m.month], m.n, m.log_loss, m.brier) for m in months], "kind string, sample string, block string, n long, log_loss double, brier double")
    drawn = E.resampled(g.where(~late), "grp", losses, {m.month: m.n for m in months}, DRAWS).join(F.broadcast(actual.select("sample", "block")), "sample")
    drawn = saved(drawn)
    blocks = lambda df, *by: df.groupBy("block", *by).agg(*(F.avg(c).alias(c) for c in losses), *([] if by else [F.sum("n").alias("n")])).withColumnRenamed("block", "sample").withColumn("kind", F.lit("block"))
    own = E.resampled(g.where(late), "grp", losses, {"all": total}, DRAWS, 18) if total else drawn.drop("block")
    means = drawn.drop("block").withColumn("kind", F.lit("month")).unionByName(blocks(drawn, "draw")).unionByName(own.withColumn("kind", F.lit("late")))
    facts = actual.drop("block").unionByName(blocks(actual)).unionByName(whole)
    long = lambda df, keep, name: df.unpivot(keep, losses, "metric", name)
    out = E.bootstrap_summary(long(means, ["kind", "sample", "draw"], "value"), long(facts, ["kind", "sample", "n"], "actual"), ["kind", "sample", "metric"])
    return rounded(out.join(F.broadcast(facts.select("kind", "sample", "n")), ["kind", "sample"]), 9)


@register(f"""WITH {PREDS}, cal AS MATERIALIZED (SELECT period, pool, y, 1.0::DOUBLE AS x1, ln(p / (1 - p)) AS x2 FROM preds), {newton("cal", ["period", "pool"], 2, free=(1, 2))}
SELECT period, pool, round(b[1], 6) AS intercept, round(b[2], 6) AS slope FROM w""")
def calibration_newton(spark, sf_dir):
    """Intercept and slope by period and pool, all segments at once."""
    return rounded(E.calibration(preds(spark, sf_dir), ["period", "pool"]))
