"""Schemas of the four input tables and of the relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG, DOUBLE, TEXT, FLAG = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
FLOAT, INT, TIME = T.FloatType(), T.IntegerType(), T.TimestampNTZType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# article_id is null in BEHAVIORS for impressions of the home page.
BEHAVIORS = _table(
    ("impression_id", LONG),
    ("article_id", INT),
    ("impression_time", TIME),
    ("read_time", FLOAT),
    ("scroll_percentage", FLOAT),
    ("device_type", T.ByteType()),
    ("article_ids_inview", T.ArrayType(INT)),
    ("article_ids_clicked", T.ArrayType(INT)),
    ("user_id", LONG),
    ("is_sso_user", FLAG),
    ("gender", T.ByteType()),
    ("postcode", T.ByteType()),
    ("age", T.ByteType()),
    ("is_subscriber", FLAG),
    ("session_id", LONG),
    ("next_read_time", FLOAT),
    ("next_scroll_percentage", FLOAT),
)

ARTICLES = _table(
    ("article_id", INT),
    ("title", TEXT),
    ("subtitle", TEXT),
    ("last_modified_time", TIME),
    ("premium", FLAG),
    ("body", TEXT),
    ("published_time", TIME),
    ("image_ids", T.ArrayType(LONG)),
    ("article_type", TEXT),
    ("url", TEXT),
    ("ner_clusters", T.ArrayType(TEXT)),
    ("entity_groups", T.ArrayType(TEXT)),
    ("topics", T.ArrayType(TEXT)),
    ("category", INT),
    ("subcategory", T.ArrayType(INT)),
    ("category_str", TEXT),
    ("total_inviews", INT),
    ("total_pageviews", INT),
    ("total_read_time", FLOAT),
    ("sentiment_score", FLOAT),
    ("sentiment_label", TEXT),
)

HISTORY = _table(
    ("user_id", LONG),
    ("article_id_fixed", T.ArrayType(INT)),
    ("read_time_fixed", T.ArrayType(FLOAT)),
)

DOCUMENT_VECTOR = _table(("article_id", INT), ("document_vector", T.ArrayType(FLOAT)))

INTERACTIONS = _table(("article_id", LONG), ("user_id", LONG), ("total_readtime", DOUBLE), ("max_scroll", DOUBLE))
SCORED = _table(("user_id", LONG), ("article_id", LONG), ("impression_time", TIME), ("score", DOUBLE))
RECOMMENDATIONS = _table(("user_id", LONG), ("article_id", LONG), ("score", DOUBLE), ("rank", INT))
METRICS = _table(("model", TEXT), ("metric", TEXT), ("value", DOUBLE))


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> None:
    """Raise ``ValueError`` naming the columns that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
