"""P08 by column: one layout for a whole column of timestamps as text.

The reference's reader takes the layout of the first value of a column, reads all of
them by it and sets the others missing.  Here the first value is found by one
aggregate, its layout is chosen from ``TIME_LAYOUTS``, and the column is parsed by
that layout alone: one parse a row, where :func:`columns.parse_timestamp` tries
one layout after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.columns import TIME_LAYOUTS, col, layout_mask, parse_layout, parse_timestamp
from txrisk.operators.accounts import row_order


def fit_layout(df: DataFrame, column: str = "Timestamp", order_by: str | None = None) -> str | None:
    """The layout of the first value that is not missing; None if there is none or it has no known layout.

    "First" is by ``order_by``, else by the order of transactions, else by the order of the files.
    """
    text = col(column).cast("string")
    if order_by is not None or {"txn_no", "TransactionID"} & set(df.columns):
        order = row_order(df, "time layout", order_by)
    else:
        order = [F.monotonically_increasing_id()]
    place = F.struct(order[0].isNull().alias("missing"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.where(col(column).isNotNull()).select(place.alias("place"), text.alias("text"))
    first = rows.agg(F.min(F.struct("place", "text")).alias("first")).select(F.col("first.text").alias("text"))
    mask = first.select(layout_mask(F.col("text"))).first()[0]
    known = [layout for i, layout in enumerate(TIME_LAYOUTS) if mask >> i & 1]
    return known[0] if known else None


def parse_time_column(df: DataFrame, column: str = "Timestamp", order_by: str | None = None) -> DataFrame:
    """``df`` with a text column parsed by its one layout; values of any other layout are missing.

    Without a known layout every value is read on its own, as the reference's reader does
    then.  A column that is no text stays as it is.
    """
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    layout = fit_layout(df, column, order_by)
    text = col(column)
    return df.withColumn(column, parse_layout(text, layout) if layout else parse_timestamp(text))
