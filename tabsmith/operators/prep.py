"""Training-time preprocessing beyond scaling.

Every statistic is fitted on training rows only. Category tables are bounded by the
cardinality cap that selects the categorical columns in the first place; per-category
statistics are joined back (adaptive execution decides broadcast vs shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.functions.columns import q, row_hash
from tabsmith.functions.ranking import hash_positions, hash_rank
from tabsmith.operators.neighbours import nearest_in_group
from tabsmith.session import cut_lineage


def one_hot_in_pipeline(frame: DataFrame, train: DataFrame, cat_cols: list[str], max_categories: int = 50):
    """One 0/1 column per training category; with more than ``max_categories`` categories
    the most frequent ``max_categories - 1`` are kept (ties by value) and the rest pooled into
    ``{col}_infrequent``. Unknown categories encode as all zeros."""
    added, exprs = [], {}
    for c in cat_cols:
        s = q(c).cast("string")
        vc = train.where(s.isNotNull()).groupBy(s.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = vc.orderBy(F.col("n").desc(), F.col("v").desc()).limit(max_categories + 1).collect()
        if len(top) <= max_categories:
            kept, pooled = sorted(r["v"] for r in top), False
        else:
            kept = sorted(r["v"] for r in top[:max_categories - 1])
            pooled = True
        for v in kept:
            name = f"{c}_{v}"
            exprs[name] = F.coalesce((s == F.lit(v)).cast("double"), F.lit(0.0))
            added.append(name)
        if pooled:
            name = f"{c}_infrequent"
            # infrequent = seen in training but not kept; unseen values stay all-zero
            known = vc.select(F.col("v").alias("__v"), F.lit(1.0).alias(name))
            kept_set = F.array(*[F.lit(v) for v in kept])
            frame = (frame.join(known, frame[f"`{c}`"].cast("string") == known["__v"], "left")
                          .withColumn(name, F.when(F.array_contains(kept_set, s), 0.0)
                                      .otherwise(F.coalesce(F.col(name), F.lit(0.0)))).drop("__v"))
            added.append(name)
    return frame.withColumns(exprs) if exprs else frame, added


def _indicators(frame: DataFrame, target: str, task: str, classes: list) -> dict:
    y = q(target)
    if task == "regression":
        return {"": y.cast("double")}
    if len(classes) <= 2:
        pos = classes[-1]
        return {"": (y.cast("string") == F.lit(str(pos))).cast("double")}
    return {f"_{k}": (y.cast("string") == F.lit(str(k))).cast("double") for k in classes}


def target_encode_crossfit(frame: DataFrame, target: str, cat_cols: list[str], task: str, cfg,
                           folds: int = 5, key: list | None = None):
    """Shrunken target encoding, cross-fitted on the training rows.

    enc = lam * mean_c + (1 - lam) * mean, lam = var * n_c / (var * n_c + ssd_c / n_c) with the
    variance of the target and the within-category sum of squared deviations. Training rows
    in fold f use statistics of the OTHER folds (totals minus the fold, no per-fold rescan);
    test rows use all training rows; unseen categories get the mean."""
    from tabsmith.operators.split import kfold

    train = frame.where(F.col(SPLIT_COL) == "train")
    classes = []
    if task != "regression":
        classes = sorted(r[0] for r in train.select(q(target).cast("string")).distinct().collect())
    ind = _indicators(frame, target, task, classes)
    key = key or [c for c in frame.columns if c not in (SPLIT_COL,)]
    tr = kfold(train, folds, cfg.random_state, key, out="__tef")
    te = frame.where(F.col(SPLIT_COL) != "train").withColumn("__tef", F.lit(-1))
    allrows = tr.unionByName(te)
    added = []
    for suffix, yexpr in ind.items():
        t = tr.withColumn("__y", yexpr)
        glob_f = t.groupBy("__tef").agg(F.count("__y").alias("gn"), F.sum("__y").alias("gs"),
                                        F.sum(F.col("__y") * F.col("__y")).alias("gss"))
        tot_n, tot_s, tot_ss = (glob_f.agg(F.sum(c)).scalar() for c in ("gn", "gs", "gss"))
        # global stats seen by each fold (the other folds) and by the test rows (all folds, id -1)
        g = (glob_f.select("__tef", (tot_n - F.col("gn")).alias("gn"), (tot_s - F.col("gs")).alias("gs"),
                           (tot_ss - F.col("gss")).alias("gss"))
             .unionByName(glob_f.agg(F.lit(-1).alias("__tef"), F.sum("gn").alias("gn"), F.sum("gs").alias("gs"),
                                     F.sum("gss").alias("gss"))))
        g = g.select("__tef", (F.col("gs") / F.col("gn")).alias("gm"),
                     (F.col("gss") / F.col("gn") - (F.col("gs") / F.col("gn")) ** 2).alias("gv"))
        for c in cat_cols:
            name = f"{c}_te{suffix}"
            cf = t.groupBy(q(c).cast("string").alias("__k"), "__tef").agg(
                F.count("__y").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("ss"))
            tot = cf.groupBy("__k").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
            # statistics of category k seen from fold f = total - fold's own part (fold -1 = all);
            # each category row is expanded to the folds + 1 fold ids (a fixed, small factor)
            fold_ids = F.array(*[F.lit(i) for i in range(-1, folds)])
            grid = tot.withColumn("__tef", F.explode(fold_ids)).join(cf, ["__k", "__tef"], "left") \
                .na.fill(0, ["n", "s", "ss"])
            st = grid.select("__k", "__tef", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"),
                             (F.col("tss") - F.col("ss")).alias("ss")).where("n > 0")
            st = st.join(F.broadcast(g), "__tef").select(
                "__k", "__tef", "gm", "gv", (F.col("s") / F.col("n")).alias("m"),
                (F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("wv"), "n")
            lam = F.col("gv") * F.col("n") / (F.col("gv") * F.col("n") + F.col("wv"))
            st = st.select("__k", "__tef", F.when(F.isnan(lam) | lam.isNull(), F.col("gm"))
                           .otherwise(lam * F.col("m") + (1 - lam) * F.col("gm")).alias(name))
            allrows = (allrows.withColumn("__k", q(c).cast("string")).join(st, ["__k", "__tef"], "left").drop("__k"))
            allrows = allrows.join(F.broadcast(g.select("__tef", F.col("gm").alias("__gm"))), "__tef", "left") \
                .withColumn(name, F.coalesce(F.col(name), F.col("__gm"))).drop("__gm")
            added.append(name)
    return allrows.drop("__tef"), added


def full_train_codes(train: DataFrame, target: str, cat_cols: list[str], task: str) -> dict[str, list]:
    """P05 for rows that are scored: {new column: [column, {category: code}, mean]} with the shrinkage of
    :func:`target_encode_crossfit` over all training rows. One aggregate a column; as many numbers reach
    the driver as the columns have categories, which the cardinality limit bounds."""
    classes = sorted(r[0] for r in train.select(q(target).cast("string")).distinct().collect()) if task != "regression" else []
    indicators = _indicators(train, target, task, classes)
    whole = train.agg(*(f(y).alias(f"{name}{s}") for s, y in indicators.items() for name, f in (("m", F.avg), ("v", F.var_pop)))).first()
    out = {}
    for c in cat_cols:
        own = train.where(q(c).isNotNull()).groupBy(q(c).cast("string").alias("k")).agg(
            F.count("*").alias("n"), *(f(y).alias(f"{name}{s}") for s, y in indicators.items() for name, f in (("m", F.avg), ("v", F.var_pop)))).collect()
        for s in indicators:
            mean, var = whole[f"m{s}"], whole[f"v{s}"]
            codes = {}
            for r in own:
                spread = var * r["n"] + r[f"v{s}"]
                share = var * r["n"] / spread if spread > 0 else 0.0
                codes[r["k"]] = share * r[f"m{s}"] + (1 - share) * mean
            out[f"{c}_te{s}"] = [c, codes, mean]
    return out


def random_undersample(df: DataFrame, label: str, seed: int = 42, key: list | None = None) -> DataFrame:
    """Every class reduced to the minority count, keeping the rows with the smallest
    digests per class (a two-phase per-class rank, no single-task window)."""
    counts = df.groupBy(q(label).alias("c")).count()
    m = counts.agg(F.min("count")).first()[0]
    keyed = df.withColumn("__h", row_hash(key or df.columns, seed)).withColumn("__cls", q(label).cast("string"))
    ranked = hash_rank(keyed, "__h", groups=["__cls"], out="__rn")
    return ranked.where(F.col("__rn") <= m).drop("__h", "__cls", "__rn")


def _number(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts, the same in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("~", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def synthetic_minority(df: DataFrame, label: str, features: list[str], seed: int = 42, k: int = 5) -> DataFrame:
    """The synthetic rows (label, features as doubles, base digest ``__base`` and copy ``__copy``) that bring every
    class to the size of the largest.

    A class of n rows that lacks m gets m div n rows from each of its rows and one more from each of the first
    m mod n in digest order. A row's copy i lies on the segment to one of its ``k`` nearest rows of the
    class (exact, Euclidean; ties by digest; fewer in smaller classes): the neighbour and the place on
    the segment are digests of (row, i). Equal rows are each other's neighbours at distance 0; they are
    searched for as one. Rows with a null label or a null or NaN feature are neither counted nor used.
    The only row of a class is repeated as it is. The largest classes get no rows."""
    x = [q(c).cast("double") for c in features]
    fine = q(label).isNotNull()
    for c in x:
        fine = fine & c.isNotNull() & ~F.isnan(c)
    rows = df.where(fine).select(q(label).alias("label"), q(label).cast("string").alias("grp"), F.array(*x).alias("x"))
    base = F.md5(F.concat_ws("~", *(F.get("x", F.lit(i)).cast("string") for i in range(len(features)))))
    nodes = cut_lineage(rows.groupBy("label", "grp", "x").agg(F.count("*").alias("copies")).withColumn("base", base))
    sizes = nodes.groupBy("grp").agg(F.sum("copies").alias("n"))
    largest = sizes.agg(F.max("n")).scalar()
    short = sizes.withColumn("lacks", largest - F.col("n")).where("lacks > 0")
    own = hash_positions(nodes.join(short, "grp"), "base", "copies", ["grp"])
    own = own.withColumnRenamed("start", "node")  # rows before it: a number of its own in the class
    extra = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("lacks") % F.col("n") - F.col("node")))
    own = cut_lineage(own.withColumn("quota", F.col("copies") * F.floor(F.col("lacks") / F.col("n")) + extra))
    near = nearest_in_group(own.select("grp", "node", "x"), k)
    twin = own.select("grp", F.col("node").alias("to"), F.col("copies").alias("many"), F.col("x").alias("y"))
    listed = (near.select("grp", "node", F.posexplode("near").alias("at", "n")).select("grp", "node", "at", F.col("n.node").alias("to")).join(twin, ["grp", "to"])
              .groupBy("grp", "node").agg(F.array_sort(F.collect_list(F.struct("at", "many", "y"))).alias("others")))
    repeat = F.flatten(F.transform("others", lambda o: F.array_repeat(o["y"], F.least(o["many"], F.lit(k)).cast("int"))))
    twins = F.array_repeat(F.col("x"), F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    picked = own.where("quota > 0").join(listed, ["grp", "node"], "left")
    picked = picked.withColumn("choices", F.slice(F.concat(twins, F.coalesce(repeat, F.array().cast("array<array<double>>"))), 1, k))
    picked = picked.withColumn("choices", F.when(F.size("choices") > 0, F.col("choices")).otherwise(F.array("x")))
    picked = picked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    to = F.get("choices", F.pmod(_number(F.col("base"), F.col("copy"), F.lit(seed), F.lit("to")), F.size("choices")).cast("int"))
    picked = picked.select("label", "base", "copy", "x", to.alias("y"), (_number(F.col("base"), F.col("copy"), F.lit(seed), F.lit("at")) / F.lit(2.0 ** 32)).alias("u"))
    made = [(F.get("x", F.lit(i)) + F.col("u") * (F.get("y", F.lit(i)) - F.get("x", F.lit(i)))).alias(c) for i, c in enumerate(features)]
    return picked.select(F.col("label").alias(label), *made, F.col("base").alias("__base"), F.col("copy").alias("__copy"))


def smote(df: DataFrame, label: str, features: list[str], seed: int = 42, k: int = 5) -> DataFrame:
    """``label`` and ``features`` of ``df``, followed by the rows of :func:`synthetic_minority`."""
    rows = df.select(q(label).alias(label), *(q(c).cast("double").alias(c) for c in features))
    return rows.unionByName(synthetic_minority(df, label, features, seed, k).drop("__base", "__copy"))
