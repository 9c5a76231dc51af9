"""Learned labels of units: weighted bags of tokens in k clusters, a multi-class tagger, and boosted scores a class."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_clusters(df: DataFrame, tokens: str, k: int, features: int = 1024, seed: int = 0) -> DataFrame:
    """``df`` and ``cluster``: rows by k-means on tf-idf weights of their token arrays.

    Null token arrays count as empty.  An empty table, or one of fewer than two rows, gives cluster 0.
    """
    d = df.withColumn("_tokens", F.coalesce(F.col(tokens).cast("array<string>"), F.array().cast("array<string>")))
    if d.limit(2).count() < 2:
        return d.drop("_tokens").withColumn("cluster", F.lit(0))
    steps = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_weights"),
        KMeans(featuresCol="_weights", predictionCol="cluster", k=k, seed=seed),
    ]
    return Pipeline(stages=steps).fit(d).transform(d).drop("_tokens", "_tf", "_weights")


def tagger(train: DataFrame, label: str, columns: list[str], trees: int = 30, seed: int = 0):
    """A fitted pipeline: a random forest from numeric ``columns`` to the string ``label``.  Rows with a null in
    any of them are left out in training and get no prediction."""
    steps = [
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"),
        VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, seed=seed),
    ]
    return Pipeline(stages=steps).fit(train)


def boosted_scores(train: DataFrame, df: DataFrame, label: str, classes: list[int], columns: list[str], rounds: int = 20, depth: int = 4, seed: int = 0) -> DataFrame:
    """``df`` and ``score_<class>``, 0 to 1: gradient-boosted trees of each class against all others, trained on ``train``.

    Nulls of numeric ``columns`` and labels count as 0.  A class without a row in ``train``, or without another one beside
    it, scores 0 or 1 everywhere.
    """
    gather = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_features")
    numbers = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    rows = gather.transform(train.withColumns(numbers)).select("_features", F.coalesce(F.col(label), F.lit(0)).alias("_label")).persist()
    counts = {r["_label"]: r["count"] for r in rows.where(F.col("_label").isin(classes)).groupBy("_label").count().collect()}
    total = rows.count()
    out = gather.transform(df.withColumns(numbers)).drop(*numbers)
    for c in classes:
        if counts.get(c, 0) in (0, total):
            out = out.withColumn(f"score_{c}", F.lit(float(counts.get(c, 0) > 0)))
            continue
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, labelCol="_y", featuresCol="_features", predictionCol="_hat")
        model = trees.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(rows.withColumn("_y", (F.col("_label") == c).cast("double")))
        out = model.transform(out).withColumn(f"score_{c}", vector_to_array("_p")[1]).drop("_raw", "_p", "_hat")
    rows.unpersist()
    return out.drop("_features")
