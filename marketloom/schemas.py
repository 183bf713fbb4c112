"""Explicit schemas of every layer (no inference on read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, DOUBLE, LONG, BOOL, DATE, TS = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.BooleanType(),
    T.DateType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(T.StringType())

PRICES = _struct(
    ("symbol", STRING),
    ("trade_date", DATE),
    ("open", DOUBLE),
    ("high", DOUBLE),
    ("low", DOUBLE),
    ("close", DOUBLE),
    ("adjusted_close", DOUBLE),
    ("volume", LONG),
    ("dividend_amount", DOUBLE),
    ("split_ratio", DOUBLE),
    ("is_upper_lock", BOOL),
    ("is_lower_lock", BOOL),
)

ARTICLES = _struct(
    ("article_id", STRING),
    ("source", STRING),
    ("headline", STRING),
    ("summary", STRING),
    ("url", STRING),
    ("published_at", STRING),
    ("author", STRING),
    ("raw_guid", STRING),
)

ANNOUNCEMENTS = _struct(
    ("announcement_id", STRING),
    ("symbol", STRING),
    ("company_name", STRING),
    ("title", STRING),
    ("category", STRING),
    ("announcement_date", STRING),
    ("announcement_time", STRING),
    ("document_url", STRING),
    ("source", STRING),
)

SIGNALS = _struct(
    ("signal_id", STRING),
    ("raw_id", STRING),
    ("source", STRING),
    ("published_at", STRING),
    ("headline", STRING),
    ("matched_symbols", STRINGS),
    ("primary_symbol", STRING),
    ("event_category", STRING),
    ("sentiment_score", DOUBLE),
    ("sentiment_label", STRING),
    ("confidence", DOUBLE),
    ("positive_tokens", STRINGS),
    ("negative_tokens", STRINGS),
)

MACRO_RAW = _struct(
    ("indicator", STRING),
    ("observation_date", DATE),
    ("public_release_date", DATE),
    ("value", DOUBLE),
    ("unit", STRING),
    ("frequency", STRING),
    ("source", STRING),
    ("notes", STRING),
)

PREDICTIONS = _struct(
    ("prediction_id", STRING),
    ("symbol", STRING),
    ("generated_at", TS),
    ("target_date", DATE),
    ("model_name", STRING),
    ("model_version", STRING),
    ("up_probability", DOUBLE),
    ("expected_return", DOUBLE),
    ("signal", STRING),
    ("confidence", DOUBLE),
    ("feature_version", STRING),
    ("drivers_json", STRING),
    ("realized_outcome", DOUBLE),
    ("is_correct", BOOL),
)

UNIVERSE = _struct(
    ("symbol", STRING),
    ("name", STRING),
    ("sector", STRING),
    ("feed_ticker", STRING),
    ("enabled", BOOL),
)


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column if the table has it, else the default (optional-column rule)."""
    if name in df.columns:
        return F.col(name)
    return default if isinstance(default, Column) else F.lit(default)


def price_column(df: DataFrame) -> Column:
    """Adjusted close where the table carries it, else close."""
    return col_or(df, "adjusted_close", F.col("close"))
