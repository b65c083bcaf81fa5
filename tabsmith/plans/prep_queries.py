"""Registered preprocessing / text / PCA queries (P04, P05, P08, T17, T18) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators.prep import one_hot_in_pipeline, random_undersample, synthetic_minority, target_encode_crossfit
from tabsmith.operators.split import holdout_split
from tabsmith.operators.steps import apply_steps
from tabsmith.operators.text import tfidf_long
from tabsmith.operators.training import SplitConfig
from tabsmith.plans.fixtures import LINEITEM_KEY, table
from tabsmith.plans.sqlgen import R, md5_key


def _p04(s, sf):
    cu = table(s, sf, "customer")
    out, added = one_hot_in_pipeline(cu, cu, ["c_mktsegment"], 3)
    return out.select("c_custkey", *added).unpivot(["c_custkey"], added, "feature", "value")


def _p05(s, sf):
    cu = holdout_split(table(s, sf, "customer"), "c_acctbal", 0.2, 42, stratify=False, key=["c_custkey"])
    out, added = target_encode_crossfit(cu, "c_acctbal", ["c_mktsegment"], "regression", SplitConfig(), 5,
                                        key=["c_custkey"])
    return out.select("c_custkey", SPLIT_COL, F.round(added[0], 4).alias("c_mktsegment_te"))


SMOTE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _p07(s, sf):
    made = synthetic_minority(table(s, sf, "lineitem"), "l_returnflag", SMOTE_FEATURES, 42)
    return made.select("l_returnflag", F.col("__base").alias("base"), F.col("__copy").cast("long").alias("copy"), *(F.round(c, 6).alias(c) for c in SMOTE_FEATURES))


def _t17(s, sf):
    li = table(s, sf, "lineitem")
    out = apply_steps(li, [{"type": "pca_projection", "columns": ["l_quantity", "l_extendedprice", "l_discount",
                                                                  "l_tax"], "n_components": 3}])
    return out.select(*LINEITEM_KEY, *[F.round(f"PC_{j}", 4).alias(f"PC_{j}") for j in (1, 2, 3)])


QUERIES = {
    "p04_one_hot_infrequent": _p04,
    "p05_target_encode_crossfit": _p05,
    "p07_smote": _p07,
    "p08_random_undersample": lambda s, sf: random_undersample(table(s, sf, "lineitem"), "l_returnflag", 42,
                                                               LINEITEM_KEY).select(*LINEITEM_KEY, "l_returnflag"),
    "t17_pca_projection": _t17,
    "t18_tfidf": lambda s, sf: tfidf_long(table(s, sf, "documents"), "text", ["doc_id"], 50, 1)
    .select("doc_id", "term", "j", F.round("weight", 6).alias("weight")),
    "t18_tfidf_wide": lambda s, sf: apply_steps(table(s, sf, "documents").select("doc_id", "lang", "text"), [
        {"type": "tfidf_column", "column": "text", "max_features": 6}])
    .select("doc_id", *[F.round(f"tfidf_text_{j}", 6).alias(f"tfidf_text_{j}") for j in range(6)]),
    "t18_tfidf_bigrams": lambda s, sf: tfidf_long(table(s, sf, "documents"), "text", ["doc_id"], 200, 2)
    .select("doc_id", "term", "j", F.round("weight", 6).alias("weight")),
}


def _tfidf_sql(k: int, ngram: int) -> str:
    grams = "toks" if ngram == 1 else (
        "list_concat(toks, CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), "
        "lambda i: array_to_string(list_slice(toks, i, i + 1), ' ')) ELSE [] END)")
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks
           FROM documents),
t AS (SELECT doc_id, unnest({grams}) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, df FROM st ORDER BY cf DESC, term ASC LIMIT {k}),
vj AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS j FROM voc),
w AS (SELECT tf.doc_id, tf.term, vj.j,
             tf.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + vj.df)) + 1) AS raw
      FROM tf JOIN vj ON tf.term = vj.term)
SELECT doc_id, term, CAST(j AS INTEGER) AS j, {R('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))', 6)} AS weight
FROM w"""


_P05_SQL = f"""WITH lab AS (SELECT c_custkey, c_mktsegment AS k, c_acctbal AS y,
    row_number() OVER (ORDER BY {md5_key(['c_custkey'], 42)}) AS rn FROM customer),
sp AS (SELECT *, CASE WHEN rn <= (SELECT ceil(count(*) * 0.2) FROM customer) THEN 'test' ELSE 'train' END AS {SPLIT_COL}
       FROM lab),
tr AS (SELECT *, CAST((row_number() OVER (ORDER BY {md5_key(['c_custkey'], 42)}) - 1) % 5 AS INTEGER) AS f
       FROM sp WHERE {SPLIT_COL} = 'train'),
te AS (SELECT *, -1 AS f FROM sp WHERE {SPLIT_COL} <> 'train'),
rows_ AS (SELECT * FROM tr UNION ALL SELECT * FROM te),
folds AS (SELECT unnest(range(-1, 5)) AS f),
gf AS (SELECT f, count(y) AS gn, sum(y) AS gs, sum(y * y) AS gss FROM tr GROUP BY f),
gt AS (SELECT sum(gn) AS gn, sum(gs) AS gs, sum(gss) AS gss FROM gf),
g0 AS (SELECT gf.f, gt.gn - gf.gn AS gn, gt.gs - gf.gs AS gs, gt.gss - gf.gss AS gss FROM gf, gt
       UNION ALL SELECT -1, gn, gs, gss FROM gt),
g AS (SELECT f, gs / gn AS gm, gss / gn - (gs / gn) * (gs / gn) AS gv FROM g0),
cf AS (SELECT k, f, count(y) AS n, sum(y) AS s, sum(y * y) AS ss FROM tr GROUP BY k, f),
tot AS (SELECT k, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM cf GROUP BY k),
st0 AS (SELECT tot.k, folds.f, tot.n - coalesce(cf.n, 0) AS n, tot.s - coalesce(cf.s, 0) AS s,
               tot.ss - coalesce(cf.ss, 0) AS ss
        FROM tot CROSS JOIN folds LEFT JOIN cf ON cf.k = tot.k AND cf.f = folds.f),
st1 AS (SELECT st0.k, st0.f, g.gm, g.gv, s / n AS m, ss / n - (s / n) * (s / n) AS wv, n FROM st0 JOIN g ON st0.f = g.f
        WHERE n > 0),
st AS (SELECT k, f, gm, CASE WHEN isnan(gv * n / (gv * n + wv)) OR (gv * n + wv) = 0 THEN gm
                          ELSE (gv * n / (gv * n + wv)) * m + (1 - gv * n / (gv * n + wv)) * gm END AS e FROM st1)
SELECT r.c_custkey, r.{SPLIT_COL}, {R('coalesce(st.e, g.gm)')} AS c_mktsegment_te
FROM rows_ r LEFT JOIN st ON st.k = r.k AND st.f = r.f JOIN g ON g.f = r.f"""

_X = [f"CAST({c} AS DOUBLE)" for c in SMOTE_FEATURES]
_NUMBER = "('0x' || substr(md5(concat_ws('~', base, CAST(copy AS VARCHAR), '42', '{}')), 1, 8))::BIGINT"
_SMOTE_SQL = f"""WITH nodes AS (
  SELECT l_returnflag AS grp, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))}, count(*) AS copies, md5(concat_ws('~', {', '.join(f'CAST({x} AS VARCHAR)' for x in _X)})) AS base
  FROM lineitem GROUP BY ALL
), sizes AS (SELECT grp, sum(copies) AS n FROM nodes GROUP BY grp),
short AS (SELECT grp, n, (SELECT max(n) FROM sizes) - n AS lacks FROM sizes WHERE n < (SELECT max(n) FROM sizes)),
own AS (SELECT *, sum(copies) OVER (PARTITION BY grp ORDER BY base) - copies AS node FROM nodes JOIN short USING (grp)),
quotas AS (SELECT *, copies * (lacks // n) + greatest(0, least(copies, lacks % n - node)) AS quota FROM own),
near AS (
  SELECT * FROM (
    SELECT a.grp, a.base, b.copies AS many, b.x0 AS y0, b.x1 AS y1, b.x2 AS y2, row_number() OVER (PARTITION BY a.grp, a.base
      ORDER BY sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)), b.node) AS place
    FROM own a JOIN own b ON a.grp = b.grp AND a.node <> b.node) WHERE place <= 5
), listed AS (
  SELECT grp, base, 0 AS place, unnest(range(least(copies - 1, 5)::BIGINT)) AS again, x0 AS y0, x1 AS y1, x2 AS y2 FROM own
  UNION ALL SELECT grp, base, place, unnest(range(least(many, 5)::BIGINT)), y0, y1, y2 FROM near
), choices AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, base ORDER BY place, again) - 1 AS choice FROM listed) WHERE choice < 5
), lens AS (SELECT grp, base, count(*) AS len FROM choices GROUP BY grp, base),
made AS (SELECT quotas.*, unnest(range(quota::BIGINT)) AS copy FROM quotas WHERE quota > 0),
picked AS (SELECT made.*, {_NUMBER.format('to')} % len AS choice, {_NUMBER.format('at')} / 4294967296.0::DOUBLE AS u FROM made JOIN lens USING (grp, base))
SELECT p.grp AS l_returnflag, p.base, p.copy, {', '.join(f'{R(f"p.x{i} + p.u * (c.y{i} - p.x{i})", 6)} AS {c}' for i, c in enumerate(SMOTE_FEATURES))}
FROM picked p JOIN choices c ON c.grp = p.grp AND c.base = p.base AND c.choice = p.choice"""

ORACLE = {
    "p07_smote": _SMOTE_SQL,
    "p04_one_hot_infrequent": """WITH vc AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1),
kept AS (SELECT v FROM vc ORDER BY n DESC, v DESC LIMIT 2),
feats AS (SELECT 'c_mktsegment_' || v AS feature, v FROM kept UNION ALL SELECT 'c_mktsegment_infrequent', NULL)
SELECT c.c_custkey, f.feature,
  CASE WHEN f.v IS NOT NULL THEN (CASE WHEN c.c_mktsegment = f.v THEN 1.0 ELSE 0.0 END)
       ELSE (CASE WHEN c.c_mktsegment IN (SELECT v FROM kept) THEN 0.0 ELSE 1.0 END) END AS value
FROM customer c, feats f""",
    "p05_target_encode_crossfit": _P05_SQL,
    "p08_random_undersample": f"""WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_key(LINEITEM_KEY, 42)}) AS rn FROM lineitem)
SELECT {', '.join(LINEITEM_KEY)}, l_returnflag FROM r WHERE rn <= (SELECT m FROM m)""",
    "t18_tfidf": _tfidf_sql(50, 1),
    "t18_tfidf_wide": f"SELECT d.doc_id, {', '.join(f'coalesce(max(weight) FILTER (j = {j}), 0.0) AS tfidf_text_{j}' for j in range(6))} "
    f"FROM documents d LEFT JOIN ({_tfidf_sql(6, 1)}) w ON w.doc_id = d.doc_id GROUP BY d.doc_id",
    "t18_tfidf_bigrams": _tfidf_sql(200, 2),
}
