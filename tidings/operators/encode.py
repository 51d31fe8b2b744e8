"""Text to vectors: a pluggable model per executor, or hashed TF-IDF inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidings.functions.text import TOKEN_PATTERN
from tidings.operators.articles import new_articles

# Texts per model call.
BATCH_SIZE = 64
DIMENSIONS = 512


def encode_with_model(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "text",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``embedding`` from any text model.

    ``make_predict`` runs once per Python worker and returns a function from a batch of texts to a
    matrix, so the model is loaded once and texts arrive in Arrow batches.
    """
    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", predict(F.coalesce(F.col(text), F.lit(""))))


def fit_text_encoder(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """Hashed TF-IDF encoder fitted on a corpus; unit-length output."""
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    prepared = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return Pipeline(stages=stages).fit(prepared)


def encode_texts(df: DataFrame, encoder: PipelineModel, text: str = "text") -> DataFrame:
    """Add ``embedding`` with a fitted encoder, JVM-side throughout."""
    prepared = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    encoded = encoder.transform(prepared)
    vector = vector_to_array("_unit", "float32").alias("embedding")
    return encoded.select(*df.columns, vector)


def encode_new(articles: DataFrame, known: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Encode only the articles whose url has no vector yet."""
    return encode(new_articles(articles, known))
