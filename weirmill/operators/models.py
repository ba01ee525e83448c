"""Baseline classifiers: nested feature sets, logistic regression fitted on training rows only, out-of-fold scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.operators.metrics import hash32

#: The most rows a classifier is fitted on; more are thinned by a hash. Document frequencies and all else read all rows.
FIT_ROWS = 1_000_000


def features(text: str | None, numbers: list[str], size: int = 1 << 12, directions: int = 0) -> Pipeline:
    """Words and word pairs of ``text`` weighted by inverse document frequency, beside ``numbers``; with ``directions`` each of
    the two is hashed to at most 512 cells and reduced to that many principal directions."""
    stages, parts = [], list(numbers)
    size = min(size, 512) if directions else size  # the driver holds a matrix of the cells' square
    if text:
        stages = [RegexTokenizer(inputCol=text, outputCol="__w", pattern="[^\\p{L}\\p{N}]+"), NGram(n=2, inputCol="__w", outputCol="__b")]
        for source in ("__w", "__b"):
            stages += [HashingTF(inputCol=source, outputCol=f"{source}_tf", numFeatures=size), IDF(inputCol=f"{source}_tf", outputCol=f"{source}_idf")]
            parts.append(f"{source}_idf")
            if directions:
                stages.append(PCA(k=directions, inputCol=f"{source}_idf", outputCol=f"{source}_pca"))
                parts[-1] = f"{source}_pca"
    stages.append(VectorAssembler(inputCols=parts, outputCol="__features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def classifier(family: str = "logistic_regression") -> LogisticRegression | GBTClassifier:
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.01, maxIter=20) if family == "logistic_regression" else GBTClassifier(featuresCol="__features", labelCol="label", maxIter=10, seed=17)


def out_of_fold(df: DataFrame, ident: str, fold: str, k: int, text: str | None, numbers: list[str], family: str = "logistic_regression", fit_rows: int = FIT_ROWS, directions: int = 0) -> DataFrame:
    """``(id, fold, label, score)``: each fold scored by a model fitted on the others, vocabulary weights included. The
    weights come from all rows of the other folds, the classifier from at most about ``fit_rows`` of all."""
    known = df.filter("label is not null")
    if text:
        known = known.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    total, got = known.count(), None
    thin = hash32(F.lit("fit"), F.col(ident)) < F.lit(int(2**32 * min(1.0, fit_rows / max(total, 1))))
    for f in range(k):
        train = known.filter(F.col(fold) != f)
        weights = features(text, numbers, directions=directions).fit(train)
        model = classifier(family).fit(weights.transform(train.filter(thin)))
        some = model.transform(weights.transform(known.filter(F.col(fold) == f))).select(F.col(ident).alias("id"), F.col(fold).alias("fold"), "label", vector_to_array("probability")[1].alias("score"))
        got = some if got is None else got.unionByName(some)
    return got


def rule_score(identity: Column, foreign: Column, intent: Column) -> Column:
    """The rule baseline: an organisation is named, the host is not its own, and something is asked for."""
    return (F.coalesce(identity, F.lit(False)) & F.coalesce(foreign, F.lit(False)) & F.coalesce(intent, F.lit(False))).cast("int")
