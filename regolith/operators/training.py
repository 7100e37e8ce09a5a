"""Weights of the pair scorer, learnt from reviewed pairs."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 200


def balanced(df: DataFrame) -> DataFrame:
    """Weights that give both labels the same sum; the counts are two numbers."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for label, count in n.items():
        w = F.when(F.col("label") == label, F.lit(total / (len(n) * count))).otherwise(w)
    return df.withColumn("w", w)


def train(examples: DataFrame, features: tuple[str, ...], folds: int = 5, least: int = LEAST) -> dict | None:
    """examples: (id, label, the features). None below `least` examples or with one label only; else weights (their
    absolute values sum to 1), intercept, precision and recall over the folds, which a hash of the id chooses."""
    df = examples.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])).alias("features")).filter("label is not null")
    df = df.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds))).persist()
    try:
        n = df.count()
        if n < least or df.select("label").distinct().count() < 2:
            return None

        def fit(part: DataFrame):
            m = part.count()
            return LogisticRegression(maxIter=1000, regParam=1.0 / m, weightCol="w", standardization=False).fit(balanced(part))

        tallies = {"hit": 0, "said": 0, "true": 0}
        for k in range(folds):
            rest, part = df.filter(F.col("fold") != k), df.filter(F.col("fold") == k)
            if rest.select("label").distinct().count() < 2:
                continue
            got = fit(rest).transform(part).agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("hit"), F.count_if(F.col("prediction") == 1).alias("said"), F.count_if(F.col("label") == 1).alias("true")).first()
            tallies = {c: v + got[c] for c, v in tallies.items()}
        model = fit(df)
        raw = [float(x) for x in model.coefficients]
        total = sum(map(abs, raw)) or 1.0
        return {
            "weights": {f: x / total for f, x in zip(features, raw)}, "intercept": float(model.intercept), "n": n,
            "precision": tallies["hit"] / max(tallies["said"], 1), "recall": tallies["hit"] / max(tallies["true"], 1),
        }
    finally:
        df.unpersist()
