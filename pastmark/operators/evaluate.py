"""Evaluation of probability models in time order, where every group weighs the same."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators.relative import numbered_values
from pastmark.operators.state import saved


def group_losses(preds: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """(group, n, log_loss, brier): mean losses of each group."""
    target, chance = F.col(y).cast("double"), F.col(p)
    return preds.groupBy(*group).agg(F.count("*").alias("n"), F.avg(C.log_loss(target, chance)).alias("log_loss"), F.avg(C.brier(target, chance)).alias("brier"))


def macro_losses(preds: DataFrame, group: str, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(by, n_groups, n_rows, macro and micro log loss and Brier)."""
    losses = group_losses(preds, [*by, group], y, p)
    mean = lambda c: F.avg(c).alias(f"macro_{c}")
    micro = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"micro_{c}")
    return losses.groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), mean("log_loss"), mean("brier"), micro("log_loss"), micro("brier"))


def calibration(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", steps: int = 40, is_logit: bool = False) -> DataFrame:
    """(by, intercept, slope) of y on logit(p), for all segments at once: each Newton step is one aggregate of five
    sums per segment, until no segment moves. With `is_logit`, `p` is the logit or any other score. Constant p gives logit
    of the rate and a NULL slope. Without `by`, rows of one class or none are an error; a segment of one class gives NULLs."""
    seg = list(by) or ["__all"]
    rows = (preds if by else preds.withColumn("__all", F.lit(1))).select(*seg, F.col(y).cast("double").alias("y"), (F.col(p).cast("double") if is_logit else C.logit(F.col(p))).alias("z"))
    rows = saved(rows)
    fit = rows.groupBy(*seg).agg(F.avg("y").alias("rate"), (F.max("z") > F.min("z")).alias("varies")).where("rate is not null")
    fit = saved(fit.select(*seg, "rate", "varies", F.lit(0.0).alias("a"), F.lit(0.0 if is_logit else 1.0).alias("b")))
    if not by and fit.where("rate > 0 and rate < 1").isEmpty():
        raise ValueError("calibration needs rows of both classes")
    for _ in range(steps):
        both = rows.join(fit.where("varies and rate > 0 and rate < 1"), seg)
        q = C.sigmoid(F.col("a") + F.col("b") * F.col("z"))
        both = both.withColumn("r", F.col("y") - q).withColumn("w", q * (1 - q))
        s = both.groupBy(*seg).agg(F.sum("r").alias("g0"), F.sum(F.col("r") * F.col("z")).alias("g1"), F.sum("w").alias("h0"), F.sum(F.col("w") * F.col("z")).alias("h1"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("h2"))
        det = F.nullif(F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1"), F.lit(0.0))
        da = F.coalesce((F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det, F.lit(0.0))
        db = F.coalesce((F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det, F.lit(0.0))
        moved = (F.abs(da) + F.abs(db) > 1e-10).alias("moved")
        fit = saved(fit.join(s, seg, "left").select(*seg, "rate", "varies", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), moved))
        if fit.where("moved").isEmpty():
            break
    mixed = (F.col("rate") > 0) & (F.col("rate") < 1)
    intercept = F.when(mixed & F.col("varies"), F.col("a")).when(mixed, F.ln(F.col("rate") / (1 - F.col("rate"))))
    return fit.select(*by, intercept.alias("intercept"), F.when(mixed & F.col("varies"), F.col("b")).alias("slope"))


def confusion(preds: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1, specificity), all thresholds in one pass."""
    hit, pos = lambda t: F.col(p) >= t, F.col(y) == 1
    wide = preds.agg(*(F.count_if(c).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in (("tp", hit(t) & pos), ("fp", hit(t) & ~pos), ("fn", ~hit(t) & pos), ("tn", ~hit(t) & ~pos))))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds)))).alias("x")).select("x.*")
    col = F.col
    return rows.withColumns({"precision": C.ratio(col("tp"), col("tp") + col("fp")), "recall": C.ratio(col("tp"), col("tp") + col("fn")), "f1": C.ratio(2 * col("tp"), 2 * col("tp") + col("fp") + col("fn")), "specificity": C.ratio(col("tn"), col("tn") + col("fp"))})


def score_curve(preds: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, p, pos, neg, tp, fp): counts per distinct score and running counts from the highest; ranges of scores are
    summed apart, so no segment is in one task."""
    counted = preds.select(*by, (-F.col(p)).alias("__down"), F.when(F.col(y) == 1, 1).otherwise(0).cast("long").alias("pos"), F.when(F.col(y) == 0, 1).otherwise(0).cast("long").alias("neg"))
    n = numbered_values(counted, "__down", by, ["pos", "neg"])
    return n.select(*by, (-F.col("__down")).alias("p"), "pos", "neg", (F.col("pos_below") + F.col("pos")).alias("tp"), (F.col("neg_below") + F.col("neg")).alias("fp"))


def best_f1(preds: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row (threshold, f1): the score of greatest F1, the highest on ties."""
    curve = score_curve(preds, y, p)
    total = preds.agg(F.count_if(F.col(y) == 1).alias("n_pos"))
    f1 = curve.crossJoin(total).select("p", F.round(C.ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), 12).alias("f1"))
    return f1.agg(F.max(F.struct("f1", "p")).alias("x")).select(F.col("x.p").alias("threshold"), F.col("x.f1").alias("f1"))


def auc_ap(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(by, roc_auc, average_precision, lift), exact, ties shared."""
    curve = score_curve(preds, y, p, by)
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    below = F.sum(F.col("pos") * F.col("neg") / 2 + F.col("neg") * (F.col("tp") - F.col("pos")))
    ap = F.sum(F.col("pos") * C.ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    out = curve.groupBy(*by).agg((below / F.nullif(n_pos * n_neg, F.lit(0))).alias("roc_auc"), (ap / F.nullif(n_pos, F.lit(0))).alias("average_precision"), (n_pos / (n_pos + n_neg)).alias("prevalence"))
    return out.withColumn("lift", C.ratio(F.col("average_precision"), F.col("prevalence")))


def ranked(preds: DataFrame, group: str, member: str, y: str = "y", p: str = "p") -> DataFrame:
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(p), member)))


def topk_hits(preds: DataFrame, group: str, member: str, ks: Sequence[int] = (1, 2, 3), y: str = "y", p: str = "p") -> DataFrame:
    """(k, n_groups, any_hit, mean_hits, precision, micro_recall, macro_recall)."""
    r = ranked(preds, group, member, y, p)
    g = r.groupBy(group).agg(F.sum(F.col(y).cast("long")).alias("pos"), *(F.count_if((F.col("rank") <= k) & (F.col(y) == 1)).alias(f"h{k}") for k in ks), *(F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks))
    rows = g.select("pos", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h"), F.col(f"n{k}").alias("n")) for k in ks))).alias("x")).select("pos", "x.*")
    return rows.groupBy("k").agg(F.count("*").alias("n_groups"), F.avg((F.col("h") > 0).cast("int")).alias("any_hit"), F.avg("h").alias("mean_hits"), (F.sum("h") / F.sum("n")).alias("precision"), (F.sum("h") / F.sum("pos")).alias("micro_recall"), F.avg(C.ratio(F.col("h"), F.col("pos"))).alias("macro_recall"))


def hit_distribution(preds: DataFrame, group: str, member: str, ks: Sequence[int] = (1, 2, 3), y: str = "y", p: str = "p") -> DataFrame:
    """(k, hits, n_groups, share): how many groups have so many hits among their first k."""
    r = ranked(preds, group, member, y, p)
    g = r.groupBy(group).agg(*(F.count_if((F.col("rank") <= k) & (F.col(y) == 1)).alias(f"h{k}") for k in ks))
    rows = g.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks))).alias("x")).select("x.*")
    n = rows.groupBy("k", "hits").agg(F.count("*").alias("n_groups"))  # a few rows per k
    return n.withColumn("share", F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy("k")))


def reproduced(stored: DataFrame, again: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, metric, stored, again, difference, same): each stored metric against the one found again; one that either
    side lacks is not the same."""
    long = lambda df, name: df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", name)
    out = long(stored, "stored").join(long(again, "again"), [*keys, "metric"], "full").withColumn("difference", F.abs(F.col("stored") - F.col("again")))
    return out.withColumn("same", F.coalesce(F.col("difference") <= tolerance, F.lit(False)))


def ranking_metrics(preds: DataFrame, group: str, member: str, y: str = "y", p: str = "p") -> DataFrame:
    """One row: NDCG@3, recall@1 and @3, top-1, any hit in 3, mean rank of positives, average precision; groups without
    positives are skipped."""
    r = ranked(preds, group, member, y, p).withColumn("hit", F.col(y) == 1)
    upto = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("hits", F.count_if("hit").over(upto))
    gain = 1 / F.log2(F.col("rank") + 1)
    g = r.groupBy(group).agg(
        F.count_if("hit").alias("pos"), F.sum(F.when(F.col("hit") & (F.col("rank") <= 3), gain).otherwise(0.0)).alias("dcg"),
        F.count_if(F.col("hit") & (F.col("rank") == 1)).alias("top1"), F.count_if(F.col("hit") & (F.col("rank") <= 3)).alias("top3"),
        F.avg(F.when(F.col("hit"), F.col("rank"))).alias("rank"), F.avg(F.when(F.col("hit"), F.col("hits") / F.col("rank"))).alias("ap"),
    ).where("pos > 0")
    ideal = F.when(F.col("pos") == 1, 1.0).when(F.col("pos") == 2, 1 + 1 / F.log2(F.lit(3.0))).otherwise(1.5 + 1 / F.log2(F.lit(3.0)))
    return g.agg(F.count("*").alias("n_groups"), F.avg(F.col("dcg") / ideal).alias("ndcg3"), F.avg(F.col("top1") / F.col("pos")).alias("recall1"), F.avg(F.col("top3") / F.col("pos")).alias("recall3"), F.avg("top1").alias("top1"), F.avg((F.col("top3") > 0).cast("int")).alias("any3"), F.avg("rank").alias("mean_positive_rank"), F.avg("ap").alias("mean_ap"))


def mix_decomposition(losses: DataFrame, segment: str, period: str, first: str, second: str, loss: str) -> DataFrame:
    """One row: the change of a mean between two periods as composition, within-segment and one-sided support parts.

    Over segments that both periods have, composition is the mean of both periods' values times the change of shares,
    and the within part the reverse; the parts add up to the change."""
    cell = lambda q, f: f.alias(q)
    n = losses.where(F.col(period).isin(first, second)).groupBy(segment).agg(*(cell(f"{k}{i}", f) for i, q in enumerate((first, second)) for k, f in (("n", F.count_if(F.col(period) == q)), ("m", F.avg(F.when(F.col(period) == q, F.col(loss)))))))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    whole = Window.partitionBy()  # one row per segment
    share = lambda i: F.col(f"n{i}") / F.sum(F.when(both, F.col(f"n{i}"))).over(whole)
    s = n.withColumn("s0", share(0)).withColumn("s1", share(1)).withColumn("both", both)
    on = lambda e: F.sum(F.when(F.col("both"), e))
    col = F.col
    out = s.agg(
        (F.sum(col("n0") * col("m0")) / F.sum("n0")).alias("first_mean"), (F.sum(col("n1") * col("m1")) / F.sum("n1")).alias("second_mean"),
        on(0.5 * (col("s1") - col("s0")) * (col("m0") + col("m1"))).alias("composition"), on(0.5 * (col("m1") - col("m0")) * (col("s0") + col("s1"))).alias("within"),
        on(col("s0") * col("m0")).alias("__c0"), on(col("s1") * col("m1")).alias("__c1"),
    )
    out = out.withColumn("total_change", col("second_mean") - col("first_mean")).withColumn("first_only", col("__c0") - col("first_mean")).withColumn("second_only", col("second_mean") - col("__c1"))
    return out.withColumn("residual", col("total_change") - col("composition") - col("within") - col("first_only") - col("second_only")).drop("__c0", "__c1")


def stability(cells: DataFrame, pattern: Sequence[str], place: Sequence[str], fold: str, value: str, folds: Sequence, least: int) -> DataFrame:
    """(pattern, n_folds, median_spread, median_correlation, common_cells, same_sign_cells): does a pattern, a value per
    place, come again in each fold?

    The spread is from the least to the greatest value of a fold. Each two folds are correlated over the places both
    have, if these are `least` or more, all pairs of folds in one aggregate of the places. Common are the places that all
    folds with any place have. `folds`: the folds there are; few, as are places of a pattern."""
    names = [f"__f{i}" for i in range(len(folds))]
    wide = cells.groupBy(*pattern, *place).agg(*(F.max(F.when(F.col(fold) == f, F.col(value))).alias(n) for f, n in zip(folds, names, strict=True)))
    of_pattern = Window.partitionBy(*pattern)
    used = sum((F.max(F.col(n).isNotNull().cast("int")).over(of_pattern) for n in names), F.lit(0))
    known = F.filter(F.array(*names), F.isnotnull)
    wide = wide.select("*", used.alias("__used"), known.alias("__known"))
    common = F.size("__known") == F.col("__used")
    same = common & (F.forall("__known", lambda x: x > 0) | F.forall("__known", lambda x: x < 0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) >= least
    found = wide.groupBy(*pattern).agg(
        F.first("__used").alias("n_folds"), F.array(*(F.max(n) - F.min(n) for n in names)).alias("__spreads"), F.array(*(F.when(both(a, b), F.corr(a, b)) for a, b in pairs)).cast("array<double>").alias("__pairs"),
        F.count_if(common).alias("common_cells"), F.count_if(same).alias("same_sign_cells"),
    )
    return found.select(*pattern, "n_folds", C.middle(F.col("__spreads")).alias("median_spread"), C.middle(F.col("__pairs")).alias("median_correlation"), "common_cells", "same_sign_cells")


def directions(cells: DataFrame, pattern: Sequence[str], place: str, fold: str, value: str) -> DataFrame:
    """(pattern, same_direction): in how many folds the last place is above the first one, or below it, whichever is more."""
    ends = cells.groupBy(*pattern, fold).agg((F.max_by(value, place) - F.min_by(value, place)).alias("__d"))
    return ends.groupBy(*pattern).agg(F.greatest(F.count_if(F.col("__d") > 0), F.count_if(F.col("__d") < 0)).alias("same_direction"))


def bootstrap(losses: DataFrame, index: str, loss: str, n: int, draws: int, drawn: Column) -> DataFrame:
    """(draw, mean): means of n values drawn with replacement, `draws` times. `losses` has `index` from 0 to n - 1;
    `drawn` gives an index from the columns draw and slot. No value set is collected: draws find values by equi-join."""
    slots = losses.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    picked = slots.withColumn(index, drawn).join(losses.select(index, loss), index)
    return picked.groupBy("draw").agg(F.avg(loss).alias("mean"))


def numbered(df: DataFrame, key: str, index: str = "i", width: int = 4096) -> DataFrame:
    """`index` from 0 in the order of `key`, distinct integers. Rows are numbered within ranges of `width` keys, and
    ranges within groups of as many; running sums of their sizes give the rest, so no window holds all rows."""
    spans = df.withColumn("__b", F.floor(F.col(key) / width)).withColumn("__g", F.floor(F.col("__b") / width))
    sizes = spans.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    before = lambda by, *group: F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("__g").agg(F.sum("__n").alias("__n")).select("__g", before("__g").alias("__far"))  # one row per width^2 keys
    offsets = sizes.select("__g", "__b", before("__b", "__g").alias("__near")).join(groups, "__g").select("__b", (F.col("__far") + F.col("__near")).alias("__at"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return spans.withColumn("__own", own).join(offsets, "__b").select(*df.columns, (F.col("__at") + F.col("__own")).cast("long").alias(index))


#: Values in a bucket of a bootstrap, draws in a chunk of it, and indices drawn at a time.
BUCKET_VALUES, CHUNK_DRAWS, AT_ONCE = 1 << 16, 500, 1 << 20


def resampled(values: DataFrame, key: str, losses: Sequence[str], sizes: Mapping[str, int], draws: int, seed: int = 17) -> DataFrame:
    """(sample, draw, one mean per loss): for each named sample size, `draws` times the means of so many rows of `values`,
    drawn with replacement from all of them. `key` is a distinct column; losses are not null.

    Rows are dealt to buckets by a hash. How many of a draw's rows fall into a bucket is a multinomial draw, found by
    halving the range of buckets with binomials that depend on seed, sample, chunk and range only, so all tasks agree
    without a shuffle; a task draws its bucket's rows. Work is all rows drawn, shuffled are sums by draw and bucket."""
    buckets = 1 + values.count() // BUCKET_VALUES
    dealt = saved(values.select(F.col(key).alias("__key"), *losses, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")))
    found = dict(dealt.groupBy("__bucket").count().collect())  # one row per bucket
    counts = [found.get(b, 0) for b in range(buckets)]
    chunks = -(-draws // CHUNK_DRAWS)
    names, sizes, losses = list(sizes), [int(n) for n in sizes.values()], list(losses)

    def draw(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("__key")
        bucket, chunk = int(frame["__bucket"].iloc[0]), int(frame["__chunk"].iloc[0])
        first, n = chunk * CHUNK_DRAWS, min(CHUNK_DRAWS, draws - chunk * CHUNK_DRAWS)
        columns, parts = [frame[c].to_numpy("float64") for c in losses], []
        for s, (name, size) in enumerate(zip(names, sizes, strict=True)):
            taken, low, high = np.full(n, size, "int64"), 0, buckets
            while high - low > 1:
                middle = (low + high) // 2
                left, both = sum(counts[low:middle]), sum(counts[low:high])
                rest = np.random.default_rng([seed, s, chunk, low, high]).binomial(taken, left / both)
                taken, low, high = (rest, low, middle) if bucket < middle else (taken - rest, middle, high)
            random, sums, at = np.random.default_rng([seed, s, chunk, bucket]), np.zeros((len(losses), n)), 0
            ends = np.cumsum(taken)
            while at < n:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                some = np.flatnonzero(taken[at:stop])
                if len(some):
                    picked = random.integers(0, len(frame), int(taken[at:stop].sum()), "int32")
                    begins = np.cumsum(taken[at:stop][some]) - taken[at:stop][some]
                    for c, values in enumerate(columns):
                        sums[c, at + some] = np.add.reduceat(values[picked], begins)
                at = stop
            parts.append(pd.DataFrame({"sample": name, "draw": np.arange(first, first + n)} | {c: sums[k] / size for k, c in enumerate(losses)}))
        return pd.concat(parts)

    spread = dealt.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(max(8, buckets * chunks), "__bucket", "__chunk")
    parts = spread.groupBy("__bucket", "__chunk").applyInPandas(draw, ", ".join(["sample string, draw long", *(f"{c} double" for c in losses)]))
    return parts.groupBy("sample", "draw").agg(*(F.sum(c).alias(c) for c in losses))


#: The quantiles of a bootstrap's distribution and their names.
QUANTILES = {"p2_5": 0.025, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p97_5": 0.975}


def bootstrap_summary(means: DataFrame, actual: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Per `by`: draws, mean, seven quantiles, the actual value, and the share of draws at or above it. `actual` has a
    row per `by` with the column actual."""
    both = means.join(F.broadcast(actual), list(by))  # one row per sample and metric
    return both.groupBy(*by).agg(F.count("*").alias("draws"), F.avg(value).alias("mean"), *(F.percentile(value, q).alias(n) for n, q in QUANTILES.items()), F.first("actual").alias("actual"), F.avg((F.col(value) >= F.col("actual")).cast("int")).alias("share_at_or_above"))


def numeric_drift(df: DataFrame, period: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """(metric, and per period rows, null rate, mean, p10, p50, p90, and the change of mean and p50)."""
    from pastmark.operators.profile import quantile_profile

    q = quantile_profile(df.where(F.col(period).isin(first, second)), [period], columns, (0.1, 0.5, 0.9))
    value = lambda c, v: F.max(F.when(F.col(period) == v, F.col(c)))
    parts = ("n_rows", "null_rate", "mean", "p10", "p50", "p90")
    out = q.groupBy("metric").agg(*(value(c, v).alias(f"{n}_{c}") for n, v in (("first", first), ("second", second)) for c in parts))
    return out.withColumn("mean_change", F.col("second_mean") - F.col("first_mean")).withColumn("p50_change", F.col("second_p50") - F.col("first_p50"))


def category_drift(df: DataFrame, period: str, first: str, second: str, category: str) -> DataFrame:
    """(category, shares in both periods, change in percentage points); a missing category has share 0."""
    n = df.groupBy(category).agg(F.count_if(F.col(period) == first).alias("a"), F.count_if(F.col(period) == second).alias("b")).where("a + b > 0")
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    out = n.select(F.col(category), share("a").alias("first_share"), share("b").alias("second_share"))
    return out.withColumn("points", 100 * (F.col("second_share") - F.col("first_share")))
