"""Metrics and diagnostics over a predictions DataFrame.

Every metric is an aggregate over the predictions (grouped by ``by`` when given). Curves that
need running sums over sorted scores (ROC, AUC) use ``ordered_cumsum`` over the DISTINCT
scores, so no window spans the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import default_key, q, row_hash
from tabsmith.functions.ranking import ordered_cumsum, ordered_rank
from tabsmith.operators.profile import histogram_bins


def _by(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _r2(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant target gives 1 for a perfect fit, else 0 (finite R2)."""
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - sse / sst)


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: str | Sequence[str] | None = "split",
                       digits: int = 4) -> DataFrame:
    """RMSE, MAE and R2 per group (one pass, partial aggregation)."""
    g = _by(by)
    e = q(y).cast("double") - q(yhat).cast("double")
    yy = q(y).cast("double")
    agg = pred.groupBy(*g).agg(
        F.count(e).cast("long").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), (F.var_pop(yy) * F.count(yy)).alias("sst"))
    return agg.select(*g, "n", F.round(F.sqrt("mse"), digits).alias("rmse"), F.round("mae", digits).alias("mae"),
                      F.round(_r2(F.col("sse"), F.col("sst")), digits).alias("r2"))


def confusion_counts(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """(group..., actual, predicted, count) over the observed pairs (string labels)."""
    return (pred.select(*[q(c) for c in by], q(y).cast("string").alias("actual"), q(yhat).cast("string").alias("predicted"))
                .groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).cast("long").alias("count")))


def per_class_scores(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Per group and label (union of actual and predicted labels): tp, support, predicted count,
    precision, recall, f1 (0 on zero division)."""
    cc = confusion_counts(pred, y, yhat, by)
    tp = cc.where(F.col("actual") == F.col("predicted")).select(*by, F.col("actual").alias("label"), F.col("count").alias("tp"))
    sup = cc.groupBy(*by, F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    prd = cc.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("count").alias("n_pred"))
    j = (sup.join(prd, on=[*by, "label"], how="full").join(tp, on=[*by, "label"], how="left")
            .na.fill(0, ["support", "n_pred", "tp"]))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).withColumn("support", F.col("support").cast("long"))


def classification_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: str | Sequence[str] | None = "split",
                           digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted F1 per group."""
    g = _by(by)
    pc = per_class_scores(pred, y, yhat, g)
    agg = pc.groupBy(*g).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.sum(F.col("f1") * F.col("support")).alias("wf1"))
    return agg.select(*g, F.col("n").cast("long").alias("n"), F.round(F.col("tp") / F.col("n"), digits).alias("accuracy"),
                      F.round(F.col("wf1") / F.col("n"), digits).alias("f1_weighted"))


def _score_counts(pred: DataFrame, y: str, score: str, positive, by: Sequence[str]) -> DataFrame:
    pos = (q(y).cast("string") == F.lit(str(positive))).cast("long")
    return (pred.select(*[q(c) for c in by], q(score).cast("double").alias("s"), pos.alias("p"))
                .groupBy(*by, "s").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg")))


def roc_auc(pred: DataFrame, y: str = "y", score: str = "score", positive=1, by: Sequence[str] = (),
            digits: int = 6) -> DataFrame:
    """Binary ROC-AUC with ties counted one half (Mann-Whitney), per group.

    AUC = sum over distinct scores of pos(s) * (negatives below s + neg(s) / 2) / (P * N)."""
    g = list(by)
    sc = _score_counts(pred, y, score, positive, g)
    cum = ordered_cumsum(sc, "s", {"neg_le": F.col("neg")}, groups=g)
    part = cum.select(*g, (F.col("pos") * (F.col("neg_le") - F.col("neg") + F.col("neg") / 2.0)).alias("a"),
                      "pos", "neg")
    tot = part.groupBy(*g).agg(F.sum("a").alias("a"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return tot.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                 F.round(F.col("a") / (F.col("P") * F.col("N")), digits)).alias("auc"))


def confusion_matrix(pred: DataFrame, y: str = "y", yhat: str = "yhat", max_labels: int | None = None) -> DataFrame:
    """Every (actual, predicted) cell over the sorted union of labels, zeros included.

    The label set is one array (``max_labels``, default none, makes more labels an error); the grid
    is built by exploding it twice — a product of label sets, never of data rows."""
    cc = confusion_counts(pred, y, yhat)
    labels = cc.select(F.col("actual").alias("l")).union(cc.select(F.col("predicted").alias("l"))).distinct()
    arr = labels.agg(F.sort_array(F.collect_list("l")).alias("ls"), F.count(F.lit(1)).alias("k"))
    if max_labels is not None and (k := arr.select("k").first()["k"]) > max_labels:
        raise ValueError(f"confusion_matrix: {k} labels exceed max_labels={max_labels}")
    grid = arr.select(F.explode("ls").alias("actual"), "ls").select("actual", F.explode("ls").alias("predicted"))
    return (grid.join(cc, on=["actual", "predicted"], how="left")
                .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def classification_report(pred: DataFrame, y: str = "y", yhat: str = "yhat", digits: int = 6) -> DataFrame:
    """Precision, recall, f1, support per label plus accuracy, macro avg and weighted avg rows."""
    pc = per_class_scores(pred, y, yhat)
    per = pc.select(F.col("label"), "precision", "recall", "f1", "support")
    tot = pc.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n")
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / n).alias("f1"), n.alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), n.alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / n).alias("precision"),
                          (F.col("wr") / n).alias("recall"), (F.col("wf") / n).alias("f1"), n.alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def roc_curve(pred: DataFrame, y: str = "y", score: str = "score", positive=1, points: int = 80,
              drop_intermediate: bool = True, digits: int = 5) -> DataFrame:
    """ROC points (fpr, tpr) with collinear points dropped, starting at (0, 0), then
    down-sampled to ``points`` evenly spaced indices.

    Distinct scores (persisted: several small actions read them) get cumulative positives,
    negatives and their descending index from ONE ``ordered_cumsum``; neighbours for the
    collinearity test are equi-joins on the index (no global window)."""
    from pyspark import StorageLevel

    sc = _score_counts(pred, y, score, positive, []).withColumn("ns", -F.col("s")).persist(StorageLevel.MEMORY_AND_DISK)
    cum = ordered_cumsum(sc, "ns", {"tps": F.col("pos"), "fps": F.col("neg"), "i": F.lit(1)})
    pts = cum.select(F.col("i").cast("long").alias("i"), F.col("tps").cast("long").alias("tps"),
                     F.col("fps").cast("long").alias("fps")).persist(StorageLevel.MEMORY_AND_DISK)
    tot = pts.agg(F.max("i").alias("m"), F.max("tps").alias("P"), F.max("fps").alias("N")).first()
    m, P, N = tot["m"] or 0, tot["P"] or 0, tot["N"] or 0
    spark = pred.sparkSession
    start = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("tps"),
                                  F.lit(0).cast("long").alias("fps"))
    if drop_intermediate and m > 2:
        prev = pts.select((F.col("i") + 1).alias("i"), F.col("tps").alias("tp0"), F.col("fps").alias("fp0"))
        nxt = pts.select((F.col("i") - 1).alias("i"), F.col("tps").alias("tp2"), F.col("fps").alias("fp2"))
        j = pts.join(prev, "i", "left").join(nxt, "i", "left")
        keep = ((F.col("i") == m) | F.col("tp0").isNull() |
                ((F.col("fp2") - 2 * F.col("fps") + F.col("fp0")) != 0) | ((F.col("tp2") - 2 * F.col("tps") + F.col("tp0")) != 0))
        kept = j.where(keep).select("i", "tps", "fps")
    else:
        kept = pts
    allp = start.unionByName(kept).persist(StorageLevel.MEMORY_AND_DISK)
    rk = ordered_rank(allp, "i", "k")  # 1-based positions of the kept points
    n = allp.count()
    if n > points:
        step = (n - 1) / (points - 1)
        want = sorted({int(i * step) for i in range(points - 1)} | {n - 1})
        sel = rk.where((F.col("k") - 1).isin(want))
    else:
        sel = rk
    return sel.select(
        (F.col("k") - 1).cast("int").alias("point"),
        F.round(F.col("fps") / F.lit(float(N)) if N else F.lit(None).cast("double"), digits).alias("fpr"),
        F.round(F.col("tps") / F.lit(float(P)) if P else F.lit(None).cast("double"), digits).alias("tpr"))


def calibration(pred: DataFrame, y: str = "y", score: str = "score", positive=1, bins: int | None = None,
                digits: int = 5) -> DataFrame:
    """Uniform bins on [0, 1] (interior edges right-closed, i.e. a value on an edge goes to
    the lower bin), empty bins dropped: mean predicted probability and fraction of positives."""
    if bins is None:
        n = pred.count()
        bins = min(10, max(3, n // 8))
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    p = q(score).cast("double")
    b = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < p))
    pos = (q(y).cast("string") == F.lit(str(positive))).cast("double")
    g = pred.select(b.alias("bin"), p.alias("p"), pos.alias("t")).groupBy("bin").agg(
        F.avg("p").alias("mp"), F.avg("t").alias("ft"))
    return g.select(F.col("bin").cast("int").alias("bin"), F.round("mp", digits).alias("mean_predicted"),
                    F.round("ft", digits).alias("fraction_positives"))


def auc_macro_ovr(pred: DataFrame, y: str, probs: str, classes: Sequence, digits: int = 6) -> DataFrame:
    """Macro one-vs-rest AUC: the probability array is unpivoted to (class, prob) and the
    binary AUC of each class against the rest is averaged."""
    cls = F.array(*[F.lit(str(c)) for c in classes])
    long = pred.select(q(y).cast("string").alias("__y"), F.posexplode(q(probs)).alias("__i", "__p")).select(
        F.element_at(cls, F.col("__i") + 1).alias("class"), "__y", "__p")
    long = long.withColumn("__t", (F.col("__y") == F.col("class")).cast("int"))
    per = roc_auc(long, "__t", "__p", 1, by=["class"], digits=12)
    return per.agg(F.round(F.avg("auc"), digits).alias("auc_macro_ovr"))


def residual_summary(pred: DataFrame, y: str = "y", yhat: str = "yhat", digits: int = 6) -> DataFrame:
    """Rmse, mae, r2, residual mean and residual std (ddof 0)."""
    e = q(y).cast("double") - q(yhat).cast("double")
    yy = q(y).cast("double")
    a = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                 (F.var_pop(yy) * F.count(yy)).alias("sst"), F.avg(e).alias("rm"), F.stddev_pop(e).alias("rs"))
    return a.select(F.round(F.sqrt("mse"), digits).alias("rmse"), F.round("mae", digits).alias("mae"),
                    F.round(_r2(F.col("sse"), F.col("sst")), digits).alias("r2"),
                    F.round("rm", digits).alias("residual_mean"), F.round("rs", digits).alias("residual_std"))


def residual_histogram(pred: DataFrame, y: str = "y", yhat: str = "yhat", bins: int | None = None) -> DataFrame:
    """Histogram of residuals with min(24, max(8, n // 20)) equal-width bins."""
    if bins is None:
        n = pred.count()
        bins = min(24, max(8, n // 20))
    e = (q(y).cast("double") - q(yhat).cast("double")).alias("value")
    return histogram_bins(pred.select(F.lit("residual").alias("column"), e), bins, single_group="residual").drop("column")


def residual_samples(pred: DataFrame, y: str = "y", yhat: str = "yhat", n: int = 500, seed: int = 44,
                     key: Sequence[str] | None = None, digits: int = 5) -> DataFrame:
    """Up to ``n`` (actual, predicted, residual) points chosen by the smallest row digests."""
    k = row_hash(key if key else default_key(pred), seed)
    s = pred.withColumn("__h", k).orderBy("__h").limit(n)
    a, p = q(y).cast("double"), q(yhat).cast("double")
    return s.select(F.round(a, digits).alias("actual"), F.round(p, digits).alias("predicted"),
                    F.round(a - p, digits).alias("residual"))


def leaderboard(results: DataFrame, task: str) -> DataFrame:
    """Regression by RMSE ascending, classification by accuracy descending."""
    if task == "regression":
        return results.orderBy(F.col("rmse").asc_nulls_last(), F.col("model"))
    return results.orderBy(F.col("accuracy").desc_nulls_last(), F.col("model"))


def fit_hints(board: DataFrame, task: str) -> DataFrame:
    """Conservative over / underfit and fold-stability hints per model, as an array."""
    def c(name):
        return F.col(name) if name in board.columns else F.lit(None).cast("double")
    if task == "regression":
        tr, te, trm, tem, cv, cvs = c("train_r2"), c("r2"), c("train_rmse"), c("rmse"), c("cv_rmse"), c("cv_std")
        hints = [
            F.when(tr.isNotNull() & te.isNotNull() & (tr - te > 0.12) & (tr > 0.25),
                   F.lit("Possible overfit (train R² much higher than test)")),
            F.when(tr.isNotNull() & te.isNotNull() & (tr < 0.12) & (te < 0.12), F.lit("Possible underfit (weak train & test)")),
            F.when(trm.isNotNull() & tem.isNotNull() & (tem > 1e-9) & (trm < tem * 0.55), F.lit("Large RMSE gap (train vs test)")),
            F.when(cv.isNotNull() & cvs.isNotNull() & (cv > 1e-9) & (cvs / cv >= 0.18),
                   F.lit("High CV σ vs mean (unstable folds)")),
        ]
    else:
        tr, te, cvs = c("train_accuracy"), c("accuracy"), c("cv_std")
        hints = [
            F.when(tr.isNotNull() & te.isNotNull() & (tr - te > 0.1) & (tr >= 0.72),
                   F.lit("Possible overfit (train acc. much higher than test)")),
            F.when(tr.isNotNull() & te.isNotNull() & (tr < 0.52) & (te < 0.52), F.lit("Possible underfit (weak train & test)")),
            F.when(cvs.isNotNull() & (cvs >= 0.07), F.lit("High CV σ (unstable folds)")),
        ]
    return board.withColumn("hints", F.filter(F.array(*hints), lambda h: h.isNotNull()))
