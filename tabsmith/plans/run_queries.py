"""Registered run-comparison / tuning-history queries (X01–X09, H04) and their oracle SQL.

The runs are derived by Spark from lineitem: five rule predictors y_hat = l_quantity * c
(plus l_tax * 10000 for the "tax" variant) scored with D01 on a hash train / test split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import runs as X
from tabsmith.operators.metrics import regression_metrics
from tabsmith.plans.fixtures import LINEITEM_KEY, PREDS_REG_SQL, preds_reg, table
from tabsmith.plans.sqlgen import R

SCALES = [1300, 1400, 1500, 1600, 1700]
TAX_SCALES = (1400, 1600)
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def rule_predictions(s, sf):
    p = preds_reg(s, sf).join(table(s, sf, "lineitem").select(*LINEITEM_KEY, "l_quantity", "l_tax"), LINEITEM_KEY)
    p = p.withColumn("c", F.explode(F.array(*[F.lit(c) for c in SCALES])))  # 5 rule models per row
    tax = F.col("c").isin(list(TAX_SCALES))
    yhat = F.col("l_quantity") * F.col("c") + F.when(tax, F.col("l_tax") * 10000).otherwise(0.0)
    return p.select("c", "y", yhat.alias("yhat"), "split")


def rule_runs(s, sf):
    m = regression_metrics(rule_predictions(s, sf), by=["c", "split"])

    def pick(split, col):
        return F.max(F.when(F.col("split") == split, F.col(col)))
    g = m.groupBy("c").agg(*[pick("test", k).alias(k) for k in ("rmse", "mae", "r2")],
                           *[pick("train", k).alias(f"train_{k}") for k in ("rmse", "mae", "r2")])
    tax = F.col("c").isin(list(TAX_SCALES))
    return g.select(
        F.concat(F.lit("run_"), F.col("c").cast("string")).alias("run_id"), F.lit("lineitem").alias("dataset"),
        F.when(tax, "quantity_tax_rule").otherwise("quantity_rule").alias("model"), F.lit("regression").alias("task"),
        F.create_map(F.lit("model"), F.when(tax, "quantity_tax_rule").otherwise("quantity_rule"),
                     F.lit("scale"), F.col("c").cast("string"),
                     F.lit("variant"), F.when(tax, "tax").otherwise("plain")).alias("params"),
        F.create_map(*[x for k in ("rmse", "mae", "r2", "train_rmse", "train_mae", "train_r2")
                       for x in (F.lit(k), F.col(k))]).alias("metrics"),
        F.create_map().cast("map<string,string>").alias("tags"),
        # time-zone free (TIMESTAMP_NTZ): 2024-01-01 00:00 plus c minutes
        F.timestamp_add("MINUTE", F.col("c"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("started_at"),
        F.lit(None).cast("string").alias("model_path"))


def importances(s, sf):
    """Per rule run: |corr(feature, residual)| of four features (run_1400 lacks l_linenumber)."""
    li = table(s, sf, "lineitem")
    rows = li.withColumn("c", F.explode(F.array(*[F.lit(c) for c in SCALES])))
    resid = F.col("l_extendedprice") - F.col("l_quantity") * F.col("c")
    structs = [F.struct(F.lit(f).alias("feature"), F.round(F.abs(F.corr(F.col(f).cast("double"), resid)), 4)
                        .alias("importance")) for f in FEATURES]
    g = rows.groupBy("c").agg(F.array(*structs).alias("s"))
    out = g.select(F.concat(F.lit("run_"), F.col("c").cast("string")).alias("run_id"), F.inline("s"))
    return out.where(~((F.col("run_id") == "run_1400") & (F.col("feature") == "l_linenumber")))


def trials(s, sf):
    """Tuning trials derived from the rule grid: value = train RMSE of scale 1000 + 50 * number;
    every seventh trial is marked pruned."""
    p = preds_reg(s, sf).where(F.col("split") == "train").join(
        table(s, sf, "lineitem").select(*LINEITEM_KEY, "l_quantity"), LINEITEM_KEY)
    p = p.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(20))))
    e = F.col("y") - F.col("l_quantity") * (F.lit(1000) + F.col("number") * 50)
    g = p.groupBy("number").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("value"))
    return g.select("number", "value", F.when(F.col("number") % 7 == 6, "PRUNED").otherwise("COMPLETE").alias("state"))


QUERIES = {
    "x01_list_runs": lambda s, sf: X.list_runs(rule_runs(s, sf), "lineitem", ["rmse", "mae", "r2", "train_rmse",
                                                                              "train_mae", "train_r2", "cv_rmse"])
    .select("run_id", "model", "started_at", F.col("params_numeric").getItem("scale").alias("scale"),
            F.col("params_numeric").getItem("variant").alias("variant"),
            *[F.round(m, 4).alias(m) for m in ("rmse", "mae", "r2", "train_rmse", "train_mae", "train_r2")], "cv_rmse"),
    "x02_sort_runs": lambda s, sf: X.sort_runs(rule_runs(s, sf), "r2").select("run_id", "model", F.round("r2", 4)
                                                                              .alias("r2"), "position"),
    "x03_champion": lambda s, sf: X.champion(rule_runs(s, sf), "rmse").select("run_id", F.round("rmse", 4).alias("rmse")),
    "x04_metric_extremes": lambda s, sf: X.metric_extremes(rule_runs(s, sf)).select(
        "metric", F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst")),
    "x05_run_vs_champion": lambda s, sf: X.run_vs_champion(rule_runs(s, sf), "run_1300", "rmse"),
    "x06_param_compare": lambda s, sf: X.param_compare(rule_runs(s, sf), "run_1300", 3),
    "x08_align_importances": lambda s, sf: X.align_importances(importances(s, sf)),
    "x09_common_top": lambda s, sf: X.common_top(importances(s, sf), 3),
    "h04_trial_history": lambda s, sf: X.trial_history(trials(s, sf)),
}

_RUNS_SQL = f"""{PREDS_REG_SQL},
rp AS (SELECT c, y, l_quantity * c + CASE WHEN c IN (1400, 1600) THEN l_tax * 10000 ELSE 0.0 END AS yhat, split
       FROM preds_reg p JOIN lineitem l USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate),
            (SELECT unnest([{', '.join(str(c) for c in SCALES)}]) AS c)),
m AS (SELECT c, split, {R('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse, {R('avg(abs(y - yhat))')} AS mae,
             {R('1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y))')} AS r2 FROM rp GROUP BY c, split),
runs AS (SELECT 'run_' || CAST(c AS VARCHAR) AS run_id, c,
   CASE WHEN c IN (1400, 1600) THEN 'quantity_tax_rule' ELSE 'quantity_rule' END AS model,
   CASE WHEN c IN (1400, 1600) THEN 'tax' ELSE 'plain' END AS variant,
   TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c) AS started_at,
   max(CASE WHEN split = 'test' THEN rmse END) AS rmse, max(CASE WHEN split = 'test' THEN mae END) AS mae,
   max(CASE WHEN split = 'test' THEN r2 END) AS r2, max(CASE WHEN split = 'train' THEN rmse END) AS train_rmse,
   max(CASE WHEN split = 'train' THEN mae END) AS train_mae, max(CASE WHEN split = 'train' THEN r2 END) AS train_r2
   FROM m GROUP BY c),
lm AS (SELECT run_id, model, metric, value FROM runs
       UNPIVOT (value FOR metric IN (rmse, mae, r2, train_rmse, train_mae, train_r2)))"""

_IMP_SQL = """imp0 AS (SELECT 'run_' || CAST(c AS VARCHAR) AS run_id,
   round(abs(corr(CAST(l_quantity AS DOUBLE), l_extendedprice - l_quantity * c)), 4) + 0.0 AS l_quantity,
   round(abs(corr(CAST(l_discount AS DOUBLE), l_extendedprice - l_quantity * c)), 4) + 0.0 AS l_discount,
   round(abs(corr(CAST(l_tax AS DOUBLE), l_extendedprice - l_quantity * c)), 4) + 0.0 AS l_tax,
   round(abs(corr(CAST(l_linenumber AS DOUBLE), l_extendedprice - l_quantity * c)), 4) + 0.0 AS l_linenumber
   FROM lineitem, (SELECT unnest([1300, 1400, 1500, 1600, 1700]) AS c) GROUP BY c),
imp AS (SELECT run_id, feature, importance FROM imp0
        UNPIVOT (importance FOR feature IN (l_quantity, l_discount, l_tax, l_linenumber))
        WHERE NOT (run_id = 'run_1400' AND feature = 'l_linenumber'))"""

ORACLE = {
    "x01_list_runs": f"""WITH {_RUNS_SQL}
SELECT run_id, model, started_at, CAST(c AS DOUBLE) AS scale, TRY_CAST(variant AS DOUBLE) AS variant,
       rmse, mae, r2, train_rmse, train_mae, train_r2, CAST(NULL AS DOUBLE) AS cv_rmse FROM runs""",
    "x02_sort_runs": f"""WITH {_RUNS_SQL}
SELECT run_id, model, r2, CAST(row_number() OVER (ORDER BY r2 DESC NULLS LAST, run_id) AS INTEGER) AS position FROM runs""",
    "x03_champion": f"""WITH {_RUNS_SQL}
SELECT arg_min(run_id, rmse) AS run_id, min(rmse) AS rmse FROM runs WHERE rmse IS NOT NULL""",
    "x04_metric_extremes": f"""WITH {_RUNS_SQL}
SELECT metric, CASE WHEN metric IN ('rmse', 'mae', 'train_rmse', 'train_mae') THEN min(value) ELSE max(value) END AS best,
       CASE WHEN metric IN ('rmse', 'mae', 'train_rmse', 'train_mae') THEN max(value) ELSE min(value) END AS worst
FROM lm GROUP BY metric""",
    "x05_run_vs_champion": f"""WITH {_RUNS_SQL},
ch AS (SELECT arg_min(run_id, rmse) AS champ FROM runs WHERE rmse IS NOT NULL),
cv AS (SELECT metric, value AS champion_value FROM lm WHERE run_id = (SELECT champ FROM ch)),
rg AS (SELECT metric, min(value) AS mn, max(value) AS mx FROM lm GROUP BY metric),
me AS (SELECT metric, value FROM lm WHERE run_id = 'run_1300'),
j AS (SELECT me.metric, me.value, cv.champion_value, rg.mn, rg.mx,
             (me.value - rg.mn) / CASE WHEN rg.mx - rg.mn = 0 THEN 1.0 ELSE rg.mx - rg.mn END * 100 AS pct,
             me.metric IN ('rmse', 'mae', 'train_rmse', 'train_mae') AS lower
      FROM me LEFT JOIN cv ON me.metric = cv.metric JOIN rg ON me.metric = rg.metric)
SELECT metric, {R('value')} AS value, {R('champion_value')} AS champion_value, {R('value - champion_value')} AS delta,
       {R('CASE WHEN lower THEN 100 - pct ELSE pct END', 2)} AS position_pct,
       CASE WHEN lower THEN value <= champion_value ELSE value >= champion_value END AS is_best
FROM j""",
    "x06_param_compare": f"""WITH {_RUNS_SQL},
me AS (SELECT * FROM runs WHERE run_id = 'run_1300'),
oth AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id) + 1 AS slot FROM runs
        WHERE model = (SELECT model FROM me) AND run_id <> 'run_1300'),
both_ AS (SELECT run_id, 1 AS slot, c, variant, model FROM me
          UNION ALL SELECT run_id, slot, c, variant, model FROM oth WHERE slot <= 4),
lp AS (SELECT run_id, slot, 'scale' AS param, CAST(c AS DOUBLE) AS value FROM both_
       UNION ALL SELECT run_id, slot, 'variant', TRY_CAST(variant AS DOUBLE) FROM both_
       UNION ALL SELECT run_id, slot, 'model', TRY_CAST(model AS DOUBLE) FROM both_),
numeric_ AS (SELECT param FROM lp WHERE slot = 1 AND value IS NOT NULL)
SELECT param, CAST(slot AS INTEGER) AS slot, run_id, value FROM lp WHERE param IN (SELECT param FROM numeric_)""",
    "x08_align_importances": f"""WITH {_IMP_SQL},
feats AS (SELECT feature, max(importance) AS max_importance FROM imp GROUP BY feature),
rid AS (SELECT DISTINCT run_id FROM imp),
rk AS (SELECT feature, CAST(dense_rank() OVER (ORDER BY max_importance DESC, feature) AS INTEGER) AS rank FROM feats)
SELECT f.feature, r.run_id, coalesce(i.importance, 0.0) AS importance, f.max_importance, rk.rank
FROM feats f CROSS JOIN rid r LEFT JOIN imp i ON i.feature = f.feature AND i.run_id = r.run_id
JOIN rk ON rk.feature = f.feature""",
    "x09_common_top": f"""WITH {_IMP_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS r FROM imp)
SELECT feature, 'common_top' AS kind, CAST(NULL AS VARCHAR) AS run_id FROM r WHERE r <= 3 GROUP BY feature
  HAVING count(*) = (SELECT count(DISTINCT run_id) FROM imp)
UNION ALL SELECT feature, 'top1', run_id FROM r WHERE r = 1""",
    "h04_trial_history": f"""WITH {PREDS_REG_SQL},
t AS (SELECT n AS number, {R('sqrt(avg((y - l_quantity * (1000 + n * 50)) * (y - l_quantity * (1000 + n * 50))))')} AS value
      FROM preds_reg p JOIN lineitem l USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate),
           (SELECT unnest(range(0, 21)) AS n) WHERE split = 'train' GROUP BY n),
d AS (SELECT * FROM t WHERE number % 7 <> 6)
SELECT CAST(number AS INTEGER) AS number, value,
       min(value) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_value FROM d""",
}
