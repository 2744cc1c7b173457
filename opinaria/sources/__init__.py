"""Readers, writers, stored tables and shared scratch space."""
from .readers import (
    BUSINESSES,
    REVIEWS,
    Feed,
    messages,
    normalize_businesses,
    normalize_reviews,
    parse,
    read_businesses,
    read_businesses_with_rejects,
    read_reviews,
    read_reviews_with_rejects,
    read_tagged,
    read_with_rejects,
    records,
    rejects,
    stream_parsed,
    stream_reviews,
    tagged,
    union_streams,
)
from .keyed import KeyedTable
from .ordered import first_lines
from .scratch import cut, free, scoped, scratch_dir
from .sinks import write_results, write_text

__all__ = [
    "BUSINESSES", "REVIEWS", "Feed", "KeyedTable", "cut", "first_lines", "free", "messages", "normalize_businesses",
    "normalize_reviews", "parse", "read_businesses", "read_businesses_with_rejects", "read_reviews", "read_reviews_with_rejects",
    "read_tagged", "read_with_rejects", "records", "rejects", "scoped", "scratch_dir", "stream_parsed", "stream_reviews", "tagged",
    "union_streams", "write_results", "write_text",
]
