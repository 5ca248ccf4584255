"""Sentiment of text columns in CSV files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from hemline.constants import TEXT_COLUMNS
from hemline.operators.lexicon import Lexicon, with_sentiment
from hemline.operators.shaping import flatten_struct
from hemline.sources.readers import load_texts
from hemline.valence import DEFAULT_LEXICON


def score_texts(texts: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """_source, _text and the negative, positive and compound score."""
    return flatten_struct(with_sentiment(texts, "_text", lexicon, "vader"), "vader", prefix="vader_").drop("vader_neu")


def batch_sentiment(spark: SparkSession, paths: Iterable[str], text_columns: Iterable[str] = TEXT_COLUMNS,
                    lexicon: Lexicon = DEFAULT_LEXICON, multiline: bool = False) -> DataFrame:
    return score_texts(load_texts(spark, paths, text_columns, multiline), lexicon)
