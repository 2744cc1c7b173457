"""Result writers."""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def write_results(results: Mapping[str, DataFrame], out: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each flow under `out`."""
    for name, df in results.items():
        df.write.format(fmt).mode(mode).save(f"{out}/{name}")


def write_text(rows: DataFrame, order: list[Column], item: Column, head: str, empty: str, between: str, out: str, closing: str = ")") -> None:
    """Writes one long text as part files that, put together in the order of their names, are the text: `head`, then the items
    in order with `between` between them, or `head` and `empty` if there are no rows. Rows are sorted by range and written
    where they lie, so a text may have any length. `order` must tell all rows apart. Each item, and `empty`, must end with its
    `closing` character, which the writer puts there as it does line ends."""
    first = rows.agg(F.min(F.struct(*order)).alias("first")).first().first
    if first is None:
        close, texts = empty[-1], rows.sparkSession.createDataFrame([(head + empty[:-1],)], "text string")
    else:
        close = closing
        is_first = reduce(and_, (c.eqNullSafe(F.lit(x)) for c, x in zip(order, first)))
        lead = F.when(is_first, F.lit(head)).otherwise(F.lit(between))
        cut = F.expr(f"left(item, length(item) - {len(closing)})")
        texts = rows.orderBy(*order).select(lead.alias("lead"), item.alias("item")).select(F.concat("lead", cut).alias("text"))
    texts.write.mode("overwrite").option("lineSep", close).text(out)
