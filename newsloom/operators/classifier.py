"""Binary text classifier with a decision threshold, and the hook for external models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text is flagged above this probability, not at it.
THRESHOLD = 0.7


def train(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    """Fit length-normalised hashed TF-IDF and a logistic regression; both classes weigh the same in total.

    What travels between driver and tasks is one vector of ``features`` numbers, whatever the number of texts.
    """
    share = labelled.select(F.avg(F.col(label))).scalar()
    weighted = labelled.withColumn("weight", F.when(F.col(label) == 1, 1 - share).otherwise(share))
    stages = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weighted", minDocFreq=2),
        Normalizer(inputCol="weighted", outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=30, regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(weighted.select(text, F.col(label).cast("double").alias(label), "weight"))


def verdict(probability: Column) -> Column:
    """Verdict and score of a probability; where there is none, the text counts as genuine with score zero."""
    return F.struct(
        F.coalesce(probability > THRESHOLD, F.lit(False)).alias("is_fake_news"),
        F.coalesce(probability, F.lit(0.0)).alias("confidence_score"),
    )


def score(docs: DataFrame, key: str, text: str, model: PipelineModel) -> DataFrame:
    """(key, is_fake_news, confidence_score); the score is the probability of the positive class itself."""
    source = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(model.stages[0].getInputCol()))
    positive = vector_to_array(F.col("probability"))[1]
    return model.transform(source).select(key, verdict(positive).alias("v")).select(key, "v.*")


def score_with(docs: DataFrame, key: str, text: str, make_predict: Callable, batch_size: int = 64) -> DataFrame:
    """As ``score`` with a model of the caller's: ``make_predict()`` loads it once per Python worker and returns a
    function from an array of texts to an array of probabilities, called on Arrow batches."""
    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    return docs.select(key, predict(F.col(text)).alias("p")).select(key, verdict(F.col("p")).alias("v")).select(key, "v.*")


def summarize_with(docs: DataFrame, key: str, text: str, make_predict: Callable, batch_size: int = 16) -> DataFrame:
    """(key, summary) from a text-to-text model of the caller's, loaded once per Python worker."""
    predict = predict_batch_udf(make_predict, return_type=T.StringType(), batch_size=batch_size)
    return docs.select(key, predict(F.col(text)).alias("summary"))
