"""Model diagnostics that refit or perturb models.

All of them work on an assembled DataFrame (``features`` vector column or raw feature
columns, ``label``) and score with the grouped metric aggregates of ``metrics``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import q, row_hash
from tabsmith.functions.stats import column_quantiles
from tabsmith.functions.ranking import first_by_digest, hash_rank
from tabsmith.operators import metrics as M
from tabsmith.operators.models import build_estimator
from tabsmith.operators.steps import scale_params
from tabsmith.session import stored


def loo_press(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0) -> DataFrame:
    """Leave-one-out error of OLS / ridge without n refits.

    One aggregate builds the Gram matrix of [1, x] (and X'y); the driver solves the small
    (p+1) system; each row's leverage h = x' A^-1 x and LOO residual e / (1 - h) are column
    expressions. Returns n, press = sum of squared LOO residuals, loo_rmse."""
    cols = ["__one"] + list(features)
    d = df.select(F.lit(1.0).alias("__one"), *[q(c).cast("double").alias(c) for c in features],
                  q(label).cast("double").alias("__y")).na.drop()
    p = len(cols)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col(c) * F.col("__y")).alias(f"b{i}") for i, c in enumerate(cols)]
    r = d.agg(*sums).first()
    A = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            A[i, j] = A[j, i] = r[f"g{i}_{j}"]
    A += alpha * np.diag([0.0] + [1.0] * (p - 1))
    Ainv = np.linalg.pinv(A)
    beta = Ainv @ np.array([r[f"b{i}"] for i in range(p)])
    pred = sum(F.col(c) * float(beta[i]) for i, c in enumerate(cols))
    lev = sum(F.col(cols[i]) * F.col(cols[j]) * float(Ainv[i, j] * (1 if i == j else 2))
              for i in range(p) for j in range(i, p))
    e = (F.col("__y") - pred) / (1 - lev)
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("press"), F.sqrt(F.avg(e * e)).alias("loo_rmse"))


def scaler_baseline(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                    max_rows: int | None = None, seed: int = 45, key: Sequence[str] | None = None,
                    digits: int = 6) -> DataFrame:
    """OLS on numeric features under each scaler (train medians fill nulls); RMSE and R2 on
    the test rows; the best scaler by RMSE. ``max_rows`` optionally caps the training rows (the
    reference's 8,000) by digest order; the default uses all of them."""
    spark = train.sparkSession
    med = {c: v[0] for c, v in column_quantiles(train, features, (0.5,)).items()}
    fill = {c: F.coalesce(q(c).cast("double"), F.lit(med[c])) for c in features}
    tr = train.drop("features").withColumns(fill)
    te = test.drop("features").withColumns(fill)
    if max_rows:
        tr = tr.withColumn("__h", row_hash(key or list(features), seed)).orderBy("__h").limit(max_rows).drop("__h")
    # three scalers x (params, fit, score) read the same rows: persist them once
    tr = tr.select(*[q(c) for c in features], q(label)).persist(StorageLevel.MEMORY_AND_DISK)
    te = te.select(*[q(c) for c in features], q(label)).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for name in ("standard", "minmax", "robust"):
        prm = scale_params(tr, list(features), name)
        sc = {c: (q(c) - F.lit(a)) / F.lit(b) for c, (a, b) in prm.items()}
        va = VectorAssembler(inputCols=list(features), outputCol="features")
        dtr = va.transform(tr.withColumns(sc).withColumn("label", q(label).cast("double")))
        dte = va.transform(te.withColumns(sc).withColumn("label", q(label).cast("double")))
        model = build_estimator("linear_regression", "regression").fit(dtr)
        m = M.regression_metrics(model.transform(dte), "label", "prediction", by=None, digits=digits).first()
        rows.append((name, m["rmse"], m["r2"]))
    tr.unpersist()
    te.unpersist()
    best = min(rows, key=lambda t: (t[1], ["standard", "minmax", "robust"].index(t[0])))[0]
    return spark.createDataFrame([(n, r, r2, n == best) for n, r, r2 in rows],
                                 "scaler string, rmse double, r2 double, is_best boolean")


def learning_curve(data: DataFrame, model: str, task: str, hyper: dict | None = None,
                   fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0), folds: int = 2, seed: int = 42,
                   key: Sequence[str] | None = None, min_size: int = 5) -> DataFrame:
    """Nested training subsets (by digest order) of each training fold at the given
    fractions; mean train and validation score per size (RMSE for regression, accuracy for
    classification). Sizes are fractions of the training fold.

    Rows are ranked once, for the folds, with digests of 16 bytes, and stored: fits and scores read the table by columns,
    no executor caches rows. A subset is what lies below a digest (``first_by_digest``)."""
    spark = data.sparkSession
    k = key or [c for c in data.columns if c != "features"]
    # only the columns that fits and scores read are dealt; the first two bytes are the bucket
    keyed = data.select("features", "label", F.unhex(row_hash(k, seed)).alias("__h"), F.unhex(row_hash(k, seed + 1)).alias("__h2"))
    keyed = hash_rank(keyed, "__h", out="__rn", hex_digits=2).withColumn("__fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__h", "__rn")
    keyed = stored(keyed, "learning-curve")
    parts = {f: keyed.where(F.col("__fold") != f).select("features", "label", F.lower(F.hex("__h2")).alias("__h2")) for f in range(folds)}
    sized = {r["__fold"]: r["count"] for r in keyed.groupBy("__fold").count().collect()}
    counts = {f: sum(sized.values()) - sized.get(f, 0) for f in range(folds)}
    sizes_of = {f: [min(counts[f], max(min_size, int(counts[f] * frac))) for frac in fractions] for f in range(folds)}
    out = []
    for i, frac in enumerate(fractions):
        tr_scores, va_scores, sizes = [], [], []
        for f in range(folds):
            size = sizes_of[f][i]
            sub = parts[f] if size == counts[f] else first_by_digest(parts[f], "__h2", {None: size}, out="__in").where("__in")
            sub = sub.select("features", "label")
            spread = sub.agg(F.stddev_pop("label")).first()[0]
            m = build_estimator(model, task, hyper, n=size, y_std=spread or 1.0).fit(sub)
            val = keyed.where(F.col("__fold") == f).select("features", "label")
            both = m.transform(sub.withColumn("__role", F.lit("train")).unionByName(val.withColumn("__role", F.lit("val"))))
            if task == "regression":
                got = {r["__role"]: r["rmse"] for r in M.regression_metrics(both, "label", "prediction", by="__role", digits=12).collect()}
            else:
                got = {r["__role"]: r["accuracy"] for r in M.classification_metrics(both, "label", "prediction", by="__role", digits=12).collect()}
            tr_scores.append(got["train"])
            va_scores.append(got["val"])
            sizes.append(size)
        out.append((float(frac), int(round(np.mean(sizes))), round(float(np.mean(tr_scores)), 4),
                    round(float(np.mean(va_scores)), 4)))
    return spark.createDataFrame(out, "fraction double, train_size long, train_score double, val_score double")


def permutation_importance(fitted, data: DataFrame, features: Sequence[str], task: str, repeats: int = 4,
                           seed: int = 42, key: Sequence[str] | None = None, max_rows: int | None = None,
                           top: int = 40, digits: int = 5) -> DataFrame:
    """Drop in score when one feature's values are permuted among the scored rows.

    Rows are ranked once. A row gets, for each (feature, repeat), the feature value of the row whose permuted
    rank equals its own rank: digest, copy and value alone are ranked for that and gathered by rank. Rows are
    replicated per (feature, repeat) only where they are scored; ONE ``transform`` scores every copy and ONE
    grouped aggregate gives the scores. Importance = score(original) - score(permuted) with score = -RMSE or
    accuracy; mean and std (ddof 0) over repeats, top ``top`` by mean."""
    k = key or list(features) + ["label"]
    base = data.select(*[q(c).cast("double").alias(c) for c in features], q("label"), *[q(c) for c in k
                                                                                       if c not in features and c != "label"])
    if max_rows:
        base = base.withColumn("__h", row_hash(k, seed + 1)).orderBy("__h").limit(max_rows).drop("__h")
    names = list(features)
    copies = F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1)))
    fi, rep = F.floor(F.col("__copy") / repeats).cast("int"), (F.col("__copy") % repeats).cast("int")
    base = base.withColumn("__ha", row_hash(k, seed)).select(*[q(c) for c in names], "label", "__ha")
    base = hash_rank(base, "__ha", out="__ra").persist(StorageLevel.MEMORY_AND_DISK)
    donors = base.select("__ha", F.array(*[q(c) for c in names]).alias("__x"), copies.alias("__copy")).select(
        "__copy", F.md5(F.concat_ws("~", F.col("__ha"), fi.cast("string"), rep.cast("string"))).alias("__hb"), F.get("__x", fi).alias("__pv"))
    taken = hash_rank(donors, "__hb", groups=["__copy"], out="__ra").groupBy("__ra").agg(
        F.array(*[F.max(F.when(F.col("__copy") == c, F.col("__pv"))) for c in range(len(names) * repeats)]).alias("__pv"))
    perm = base.drop("__ha").join(taken, "__ra").select(*[q(c) for c in names], "label", "__pv", copies.alias("__copy"))
    perm = perm.select("label", fi.alias("fi"), rep.alias("rep"), *[q(c) for c in names], F.get("__pv", F.col("__copy")).alias("__pv"))
    perm = perm.withColumns({c: F.when(F.col("fi") == i, F.col("__pv")).otherwise(q(c)) for i, c in enumerate(names)})
    va = VectorAssembler(inputCols=names, outputCol="features")
    scored = fitted.transform(va.transform(perm)).select("fi", "rep", "label", "prediction")
    base_scored = fitted.transform(va.transform(base)).select("label", "prediction")
    if task == "regression":
        b = M.regression_metrics(base_scored, "label", "prediction", by=None, digits=12).first()["rmse"]
        per = M.regression_metrics(scored, "label", "prediction", by=["fi", "rep"], digits=12)
        imp = per.select("fi", "rep", (F.col("rmse") - F.lit(b)).alias("drop"))
    else:
        b = M.classification_metrics(base_scored, "label", "prediction", by=None, digits=12).first()["accuracy"]
        per = M.classification_metrics(scored, "label", "prediction", by=["fi", "rep"], digits=12)
        imp = per.select("fi", "rep", (F.lit(b) - F.col("accuracy")).alias("drop"))
    labels = F.array(*[F.lit(c) for c in names])
    agg = imp.groupBy("fi").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))
    out = (agg.select(F.element_at(labels, F.col("fi") + 1).alias("feature"), F.round("mean", digits).alias("mean"),
                      F.round("std", digits).alias("std"))
              .orderBy(F.col("mean").desc(), F.col("feature")).limit(top))
    rows = out.collect()  # at most ``top``
    base.unpersist()
    return data.sparkSession.createDataFrame(rows, out.schema).coalesce(1)
