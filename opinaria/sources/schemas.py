"""Schemas of the two input datasets."""
from pyspark.sql import types as T

_S, _F, _L = T.StringType(), T.FloatType(), T.LongType()

#: Numbers arrive as JSON numbers or as quoted numbers, so they are read as text and cast afterwards.
REVIEW_RAW = T.StructType(
    [T.StructField(n, _S) for n in ("review_id", "user_id", "business_id", "stars", "useful", "funny", "cool", "text", "date")]
)
REVIEW = T.StructType(
    [T.StructField(n, _S) for n in ("review_id", "user_id", "business_id")]
    + [T.StructField("stars", _F)]
    + [T.StructField(n, _L) for n in ("useful", "funny", "cool")]
    + [T.StructField("text", _S), T.StructField("date", _S), T.StructField("review_date", T.DateType())]
)
BUSINESS = T.StructType(
    [T.StructField(n, _S) for n in ("business_id", "name", "address", "city", "state", "postal_code")]
    + [T.StructField(n, _F) for n in ("latitude", "longitude", "stars")]
    + [T.StructField(n, _L) for n in ("review_count", "is_open")]
    + [
        T.StructField("attributes", T.MapType(_S, _S)),
        T.StructField("categories", _S),
        T.StructField("hours", T.MapType(_S, _S)),
    ]
)
#: As in a file: all fields as text, maps as JSON text.
BUSINESS_RAW = T.StructType([T.StructField(f.name, _S) for f in BUSINESS])
