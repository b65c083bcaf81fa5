"""Fitted preparation as Spark ML stages (P09, S13): a run is saved as one ``PipelineModel`` that takes raw
rows to predictions.

Each stage holds what was fitted as JSON in one parameter, so Spark's own writer and reader carry it;
numbers survive exactly. Categories are as many as the cardinality limit of the training lets through."""

from __future__ import annotations

import json

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import q


class Fitted(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose fitted values are JSON."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, state=None):
        super().__init__()
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def fitted(self):
        return json.loads(self.getOrDefault(self.state))


class ScaleColumns(Fitted):
    """{column: [centre, spread]}; (x - centre) / spread. Nulls stay null, absent columns are left out."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (q(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in self.fitted.items() if c in df.columns})


class OneHotColumns(Fitted):
    """{column: [kept categories, pooled categories]}; a 0/1 column for each kept one and ``_infrequent`` for the
    pooled ones, if any. Null and unseen values are zeros in all of them."""

    @classmethod
    def fit_on(cls, train: DataFrame, columns: list[str], most: int) -> "OneHotColumns":
        out = {}
        for c in columns:
            s = q(c).cast("string")
            counts = train.where(s.isNotNull()).groupBy(s.alias("v")).agg(F.count("*").alias("n"))
            ordered = [r["v"] for r in counts.orderBy(F.desc("n"), F.desc("v")).collect()]  # at most the cardinality limit
            kept = ordered if len(ordered) <= most else ordered[:most - 1]
            out[c] = [sorted(kept), sorted(set(ordered) - set(kept))]
        return cls(out)

    @property
    def columns(self) -> dict[str, tuple[str, list[str]]]:
        """Name of each new column, and the column and categories that it stands for. Characters that a vector
        assembler doesn't take in a name are written as ``_``; a name that is taken gets a number."""
        out: dict[str, tuple[str, list[str]]] = {}
        for c, (kept, pooled) in self.fitted.items():
            for label, values in [*((v, [v]) for v in kept), *([("infrequent", pooled)] if pooled else [])]:
                name = f"{c}_{label}".translate(str.maketrans(".`", "__"))
                out[name if name not in out else f"{name}_{len(out)}"] = (c, values)
        return out

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {name: F.coalesce(q(c).cast("string").isin(values).cast("double"), F.lit(0.0)) for name, (c, values) in self.columns.items()}
        return df.withColumns(new) if new else df


class TargetEncodeColumns(Fitted):
    """P05 for rows that are scored: {new column: [column, {category: code}, code of others]}."""

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for name, (c, codes, other) in self.fitted.items():
            pairs = [x for v, code in codes.items() for x in (F.lit(v), F.lit(float(code)))]
            known = F.try_element_at(F.create_map(*pairs), q(c).cast("string")) if pairs else F.lit(None).cast("double")
            new[name] = F.coalesce(known, F.lit(float(other)))
        return df.withColumns(new) if new else df


class ProjectColumns(Fitted):
    """{"columns", "means", "loadings"}; centred scores ``pca_0``, ``pca_1``, ...; null counts as 0."""

    @property
    def names(self) -> list[str]:
        return [f"pca_{j}" for j in range(len(self.fitted["loadings"]))]

    def _transform(self, df: DataFrame) -> DataFrame:
        own = self.fitted
        centred = [F.coalesce(q(c).cast("double"), F.lit(0.0)) - F.lit(m) for c, m in zip(own["columns"], own["means"], strict=True)]
        new = {}
        for name, weights in zip(self.names, own["loadings"], strict=True):
            total = F.lit(0.0)
            for x, w in zip(centred, weights, strict=True):
                total = total + x * F.lit(w)
            new[name] = total
        return df.withColumns(new)


class NameClasses(Fitted):
    """The class name of each predicted number, as ``predicted_class``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted_class", F.get(F.array(*map(F.lit, self.fitted)), F.col("prediction").cast("int")))


class LinearScores(Model, Fitted):
    """M07 fitted: {"features", "classes", "rows": [class, coefficients, intercept]}; the class with the largest
    decision value, or for two classes the sign of the second's."""

    @property
    def coefs(self) -> list:
        return [tuple(r) for r in self.fitted["rows"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        own = self.fitted
        x = vector_to_array(F.col(own["features"]))
        scores = []
        for _, weights, intercept in own["rows"]:
            total = F.lit(float(intercept))
            for i, w in enumerate(weights):
                total = total + x[i] * F.lit(float(w))
            scores.append(total)
        if len(own["classes"]) == 2:
            best = F.when(scores[0] > 0, F.lit(own["classes"][1])).otherwise(F.lit(own["classes"][0]))
        else:
            top = F.greatest(*scores) if len(scores) > 1 else scores[0]
            best = F.coalesce(*(F.when(s == top, F.lit(c)) for (c, _, _), s in zip(own["rows"], scores, strict=True)))
        return df.withColumn("prediction", best.cast("double"))


def scoring_pipeline(stages: list[Transformer], features: list[str], model, classes: list[str] | None = None) -> PipelineModel:
    """Preparation, assembly and model as one; ``transform`` takes raw rows. Other columns pass through; a row
    with a null feature is scored as Spark's model scores NaN."""
    parts = [*stages, VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), model]
    return PipelineModel([*parts, NameClasses(list(classes))] if classes else parts)
