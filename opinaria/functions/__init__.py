"""Column expressions."""
from pyspark.sql import Column, functions as F

#: The reports' order of days.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def city_label(city: str = "city", state: str = "state") -> Column:
    """`City (State)`; a missing part is an empty text."""
    return F.concat(F.coalesce(F.col(city), F.lit("")), F.lit(" ("), F.coalesce(F.col(state), F.lit("")), F.lit(")"))


def weekday_name(day: str = "review_date") -> Column:
    """Full English name of a date's day."""
    return F.date_format(F.col(day), "EEEE")


def weekday_short(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 3))


def text_digest(text: str = "text") -> Column:
    """Lower-case hex md5; texts count as the same if every byte is."""
    return F.md5(F.col(text))


def has_id(key: str) -> Column:
    """False for null and for an empty text; ids of other types are never empty."""
    return F.col(key).cast("string") != ""
