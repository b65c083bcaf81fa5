"""Registered metric / diagnostic queries (D01–D03, D08–D15, D19) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import metrics as M
from tabsmith.plans.fixtures import (
    LINEITEM_KEY,
    PREDS_BIN_SQL,
    PREDS_CLF_SQL,
    PREDS_REG_SQL,
    preds_bin,
    preds_clf,
    preds_reg,
    table,
)
from tabsmith.plans.sqlgen import R, hist_sql, md5_key


def preds_score(s, sf):
    """Binary scores on lineitem: y = (l_returnflag = 'R'), score = l_extendedprice / 100000."""
    li = table(s, sf, "lineitem")
    return li.select(*LINEITEM_KEY, (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_extendedprice") / 100000.0).alias("score"))


PREDS_SCORE_SQL = """preds_score AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / 100000.0 AS score
  FROM lineitem)"""


def preds_multi(s, sf):
    li = table(s, sf, "lineitem")
    a, n, r = F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, F.col("l_quantity") / 500.0
    t = a + n + r
    return li.select(F.col("l_returnflag").alias("y"), F.array(a / t, n / t, r / t).alias("probs"))


PREDS_MULTI_SQL = """pm AS (SELECT l_returnflag AS y, (l_discount + 0.01) AS a, (l_tax + 0.01) AS n, l_quantity / 500.0 AS r
  FROM lineitem),
pml AS (SELECT y, 'A' AS class, a / (a + n + r) AS p FROM pm UNION ALL SELECT y, 'N', n / (a + n + r) FROM pm
        UNION ALL SELECT y, 'R', r / (a + n + r) FROM pm)"""


def _board(s, sf):
    m = M.regression_metrics(preds_reg(s, sf), by="split")

    def pick(split, col):
        return F.max(F.when(F.col("split") == split, F.col(col)))
    board = m.agg(pick("train", "rmse").alias("train_rmse"), pick("test", "rmse").alias("rmse"),
                  pick("train", "r2").alias("train_r2"), pick("test", "r2").alias("r2"))
    return M.fit_hints(board.withColumn("model", F.lit("quantity_rule")), "regression")


QUERIES = {
    "d01_regression_metrics": lambda s, sf: M.regression_metrics(preds_reg(s, sf), by="split"),
    "d02_classification_metrics": lambda s, sf: M.classification_metrics(preds_clf(s, sf), by=None),
    "d03_roc_auc": lambda s, sf: M.roc_auc(preds_bin(s, sf), "y", "score", 1),
    "d03_roc_auc_large": lambda s, sf: M.roc_auc(preds_score(s, sf), "y", "score", 1),
    "d08_confusion_matrix": lambda s, sf: M.confusion_matrix(preds_clf(s, sf)),
    "d09_classification_report": lambda s, sf: M.classification_report(preds_clf(s, sf)),
    "d10_roc_curve": lambda s, sf: M.roc_curve(preds_score(s, sf), "y", "score", 1),
    "d10_roc_curve_ties": lambda s, sf: M.roc_curve(preds_bin(s, sf), "y", "score", 1),
    "d11_calibration": lambda s, sf: M.calibration(preds_bin(s, sf), "y", "score", 1),
    "d12_auc_macro_ovr": lambda s, sf: M.auc_macro_ovr(preds_multi(s, sf), "y", "probs", ["A", "N", "R"]),
    "d13_residual_summary": lambda s, sf: M.residual_summary(preds_reg(s, sf)),
    "d14_residual_histogram": lambda s, sf: M.residual_histogram(preds_reg(s, sf)),
    "d15_residual_samples": lambda s, sf: M.residual_samples(preds_reg(s, sf), key=LINEITEM_KEY),
    "d19_fit_hints": lambda s, sf: _board(s, sf).select("model", "train_rmse", "rmse", "train_r2", "r2",
                                                         F.array_join("hints", " | ").alias("hints")),
}


def _reg_sql(group: bool) -> str:
    g = "split, " if group else ""
    e = "(CAST(y AS DOUBLE) - CAST(yhat AS DOUBLE))"
    r2 = (f"CASE WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END) "
          f"ELSE 1 - sum({e} * {e}) / (var_pop(y) * count(y)) END")
    return f"""WITH {PREDS_REG_SQL}
SELECT {g}CAST(count({e}) AS BIGINT) AS n, {R(f'sqrt(avg({e} * {e}))')} AS rmse, {R(f'avg(abs({e}))')} AS mae,
  {R(r2)} AS r2
FROM preds_reg {'GROUP BY split' if group else ''}"""


PER_CLASS = """cc AS (SELECT CAST(y AS VARCHAR) AS actual, CAST(yhat AS VARCHAR) AS predicted, count(*) AS c
       FROM preds_clf GROUP BY 1, 2),
lab AS (SELECT actual AS label FROM cc UNION SELECT predicted FROM cc),
pc0 AS (SELECT label,
          coalesce((SELECT sum(c) FROM cc WHERE actual = label), 0) AS support,
          coalesce((SELECT sum(c) FROM cc WHERE predicted = label), 0) AS n_pred,
          coalesce((SELECT sum(c) FROM cc WHERE actual = label AND predicted = label), 0) AS tp
        FROM lab),
pc1 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
       FROM pc1)"""


def _auc_sql(src: str, by: str = "") -> str:
    bsel = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""sc AS (SELECT {bsel}CAST(score AS DOUBLE) AS s, sum(CASE WHEN CAST(y AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN CAST(y AS VARCHAR) = '1' THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {bsel}s),
cu AS (SELECT *, sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM sc),
au AS (SELECT {bsel}sum(pos * (neg_le - neg + neg / 2.0)) AS a, sum(pos) AS P, sum(neg) AS N FROM cu {'GROUP BY ' + by if by else ''})"""


def _roc_sql(src_cte: str, src: str) -> str:
    return f"""WITH {src_cte},
sc AS (SELECT CAST(score AS DOUBLE) AS s, sum(CASE WHEN CAST(y AS VARCHAR) = '1' THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN CAST(y AS VARCHAR) = '1' THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY 1),
cu AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
              sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
              row_number() OVER (ORDER BY s DESC) AS i FROM sc),
nb AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp0, lag(fps) OVER (ORDER BY i) AS fp0,
              lead(tps) OVER (ORDER BY i) AS tp2, lead(fps) OVER (ORDER BY i) AS fp2, max(i) OVER () AS m FROM cu),
kept AS (SELECT i, tps, fps FROM nb WHERE i = m OR tp0 IS NULL OR (fp2 - 2 * fps + fp0) <> 0 OR (tp2 - 2 * tps + tp0) <> 0
         UNION ALL SELECT 0, 0, 0),
rk AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM kept),
tot AS (SELECT max(tps) AS p_tot, max(fps) AS n_tot FROM cu),
want AS (SELECT DISTINCT CAST(floor(CAST(j AS DOUBLE) * ((n - 1) / 79)) AS BIGINT) AS k
         FROM (SELECT max(n) AS n FROM rk), range(0, 79) t(j)
         UNION SELECT max(n) - 1 FROM rk)
SELECT CAST(k AS INTEGER) AS point, {R('fps / n_tot', 5)} AS fpr, {R('tps / p_tot', 5)} AS tpr
FROM rk, tot WHERE n <= 80 OR k IN (SELECT k FROM want)"""


def _calib_sql() -> str:
    # bins = min(10, max(3, n // 8)) with n = rows of preds_bin; edges i / bins
    return f"""WITH {PREDS_BIN_SQL},
nb AS (SELECT least(10, greatest(3, count(*) // 8)) AS b FROM preds_bin),
binned AS (SELECT score, y, (SELECT count(*) FROM range(1, (SELECT b FROM nb)) t(i)
                             WHERE CAST(i AS DOUBLE) * (1.0 / (SELECT b FROM nb)) < score) AS bin FROM preds_bin)
SELECT CAST(bin AS INTEGER) AS bin, {R('avg(score)', 5)} AS mean_predicted,
       {R("avg(CASE WHEN CAST(y AS VARCHAR) = '1' THEN 1.0 ELSE 0.0 END)", 5)} AS fraction_positives
FROM binned GROUP BY bin"""


ORACLE = {
    "d01_regression_metrics": _reg_sql(True),
    "d02_classification_metrics": f"""WITH {PREDS_CLF_SQL}, {PER_CLASS}
SELECT CAST(sum(support) AS BIGINT) AS n, {R('sum(tp) / sum(support)')} AS accuracy,
       {R('sum(f1 * support) / sum(support)')} AS f1_weighted FROM pc""",
    "d03_roc_auc": f"""WITH {PREDS_BIN_SQL}, {_auc_sql('preds_bin')}
SELECT CASE WHEN P > 0 AND N > 0 THEN {R('a / (P * N)', 6)} END AS auc FROM au""",
    "d03_roc_auc_large": f"""WITH {PREDS_SCORE_SQL}, {_auc_sql('preds_score')}
SELECT CASE WHEN P > 0 AND N > 0 THEN {R('a / (P * N)', 6)} END AS auc FROM au""",
    "d08_confusion_matrix": f"""WITH {PREDS_CLF_SQL},
cc AS (SELECT CAST(y AS VARCHAR) AS actual, CAST(yhat AS VARCHAR) AS predicted, count(*) AS c FROM preds_clf GROUP BY 1, 2),
lab AS (SELECT actual AS l FROM cc UNION SELECT predicted FROM cc)
SELECT a.l AS actual, p.l AS predicted, CAST(coalesce(cc.c, 0) AS BIGINT) AS count
FROM lab a, lab p LEFT JOIN cc ON cc.actual = a.l AND cc.predicted = p.l""",
    "d09_classification_report": f"""WITH {PREDS_CLF_SQL}, {PER_CLASS},
t AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM pc)
SELECT label, {R('precision', 6)} AS precision, {R('recall', 6)} AS recall, {R('f1', 6)} AS f1,
       CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, {R('tp / n', 6)}, CAST(n AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', {R('mp', 6)}, {R('mr', 6)}, {R('mf', 6)}, CAST(n AS BIGINT) FROM t
UNION ALL SELECT 'weighted avg', {R('wp / n', 6)}, {R('wr / n', 6)}, {R('wf / n', 6)}, CAST(n AS BIGINT) FROM t""",
    "d10_roc_curve": _roc_sql(PREDS_SCORE_SQL, "preds_score"),
    "d10_roc_curve_ties": _roc_sql(PREDS_BIN_SQL, "preds_bin"),
    "d11_calibration": _calib_sql(),
    "d12_auc_macro_ovr": f"""WITH {PREDS_MULTI_SQL},
bin AS (SELECT class, p AS score, CASE WHEN y = class THEN 1 ELSE 0 END AS y FROM pml),
{_auc_sql('bin', 'class')}
SELECT {R('avg(a / (P * N))', 6)} AS auc_macro_ovr FROM au""",
    "d13_residual_summary": f"""WITH {PREDS_REG_SQL}, e AS (SELECT y, CAST(y AS DOUBLE) - CAST(yhat AS DOUBLE) AS e FROM preds_reg)
SELECT {R('sqrt(avg(e * e))', 6)} AS rmse, {R('avg(abs(e))', 6)} AS mae,
  {R('CASE WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum(e * e) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum(e * e) / (var_pop(y) * count(y)) END', 6)} AS r2,
  {R('avg(e)', 6)} AS residual_mean, {R('stddev_pop(e)', 6)} AS residual_std FROM e""",
    "d14_residual_histogram": f"""WITH {PREDS_REG_SQL}
SELECT bin, lo, hi, count FROM ({hist_sql("SELECT 'residual' AS \"column\", CAST(y AS DOUBLE) - CAST(yhat AS DOUBLE) AS value FROM preds_reg", 24)})""",
    "d15_residual_samples": f"""WITH {PREDS_REG_SQL}
SELECT {R('y', 5)} AS actual, {R('yhat', 5)} AS predicted, {R('y - yhat', 5)} AS residual
FROM preds_reg ORDER BY {md5_key(LINEITEM_KEY, 44)} LIMIT 500""",
    "d19_fit_hints": f"""WITH {PREDS_REG_SQL},
m AS (SELECT split, {R('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
        {R('1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y))')} AS r2 FROM preds_reg GROUP BY split),
b AS (SELECT tr.rmse AS train_rmse, te.rmse AS rmse, tr.r2 AS train_r2, te.r2 AS r2
      FROM m tr, m te WHERE tr.split = 'train' AND te.split = 'test')
SELECT 'quantity_rule' AS model, train_rmse, rmse, train_r2, r2,
  array_to_string(list_filter([
    CASE WHEN train_r2 - r2 > 0.12 AND train_r2 > 0.25 THEN 'Possible overfit (train R² much higher than test)' END,
    CASE WHEN train_r2 < 0.12 AND r2 < 0.12 THEN 'Possible underfit (weak train & test)' END,
    CASE WHEN rmse > 1e-9 AND train_rmse < rmse * 0.55 THEN 'Large RMSE gap (train vs test)' END
  ], lambda h: h IS NOT NULL), ' | ') AS hints
FROM b""",
}
