"""Schema-driven profile of any table (e.g. an uploaded CSV).

The numeric statistics and the high-risk totals are one global aggregate; the
value counts are one narrow aggregate over the key columns.  Both reduce
map-side, so only a row per task and (key, value) rows cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.columns import col, numeric_value


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in column order (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, Spark type name."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, name string, type string")


def numeric_stats_aggs(df: DataFrame, cols: list[str] | None = None) -> list[Column]:
    cols = numeric_columns(df) if cols is None else cols
    aggs = []
    for i, name in enumerate(cols):
        x = numeric_value(df, name)
        aggs += [
            F.avg(x).alias(f"_m{i}"),
            F.stddev_samp(x).alias(f"_s{i}"),
            F.min(x).alias(f"_lo{i}"),
            F.max(x).alias(f"_hi{i}"),
        ]
    return aggs


def numeric_profile(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Per numeric column mean, sample std, min, max (missing skipped).

    One global aggregate (partial per partition) with 4 x N expressions, then
    the single result row is unpivoted with ``inline`` into N rows.
    """
    cols = numeric_columns(df)
    schema = "position int, column string, mean double, std double, min double, max double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*numeric_stats_aggs(df, cols))

    def r(c):
        return F.round(c, digits) if digits is not None else c

    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            r(F.col(f"_m{i}")).alias("mean"),
            r(F.col(f"_s{i}")).alias("std"),
            F.col(f"_lo{i}").alias("min"),
            F.col(f"_hi{i}").alias("max"),
        )
        for i, name in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def amount_column(df: DataFrame) -> str | None:
    for name in ("Amount", "AmountTaken"):
        if name in df.columns:
            return name
    return None


COUNT_SECTIONS = [("Risk", "risk_distribution"), ("CardUsed", "card_usage"), ("TransactionMode", "transaction_modes")]


def value_count_rows(df: DataFrame) -> DataFrame:
    """(section, key, n): value counts of the key columns present, as rows.

    One grouping-sets aggregate over the keys alone: each row is expanded to a
    narrow row per key, reduced map-side, and the counts are never gathered.
    """
    cells = value_cells(df)
    if not cells:
        return df.sparkSession.createDataFrame([], "section string, key string, n long")
    keys = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return keys.where(F.col("key").isNotNull()).groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


def value_cells(df: DataFrame) -> list[Column]:
    """A struct (section, key) for each of the counted columns that are present."""
    return [F.struct(F.lit(s).alias("section"), numeric_safe(df, c).alias("key")) for c, s in COUNT_SECTIONS if c in df.columns]


def numeric_safe(df: DataFrame, name: str) -> Column:
    """A key column as text; NaN is missing."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return numeric_value(df, name).cast("string")
    return col(name).cast("string")


def totals_row(df: DataFrame) -> DataFrame:
    """One row: the row count, four statistics per numeric column, the high-risk totals."""
    aggs = [F.count(F.lit(1)).alias("_n")] + numeric_stats_aggs(df)
    if "Risk" in df.columns:
        high = F.col("Risk") == "HIGH"
        amt = amount_column(df)
        hi_amt = F.sum(F.when(high, numeric_value(df, amt))) if amt else F.lit(None)
        aggs += [F.count_if(high).alias("_hi_n"), F.coalesce(hi_amt, F.lit(0.0)).cast("double").alias("_hi_amt")]
    return df.agg(*aggs)


def profile_long(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """A13 in long form: rows (section, key, value), in two passes.

    Sections: total_transactions, mean/std/min/max per numeric column,
    risk_distribution per value (``LOW = n`` when there is no Risk column),
    high_risk_count, high_risk_amount, card_usage and transaction_modes per
    value when those columns exist.  Missing keys are dropped from the value
    counts, as pandas ``value_counts`` does.  The statistics are one global
    aggregate; the counts stay rows, however many values a column has.
    """
    counts = value_count_rows(df).select("section", "key", F.col("n").cast("double").alias("value"))
    return long_rows(totals_row(df), df, digits).union(counts)


def long_rows(totals: DataFrame, df: DataFrame, digits: int | None) -> DataFrame:
    """The one row of :func:`totals_row` for the columns of ``df`` as rows (section, key, value)."""
    nums = numeric_columns(df)

    def row(section, key, value):
        return F.struct(
            F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")
        )

    def r(c):
        return F.round(c, digits) if digits is not None else c

    total = [row("total_transactions", F.lit(None), F.col("_n"))]
    for i, name in enumerate(nums):
        total += [
            row("mean", F.lit(name), r(F.col(f"_m{i}"))),
            row("std", F.lit(name), r(F.col(f"_s{i}"))),
            row("min", F.lit(name), F.col(f"_lo{i}")),
            row("max", F.lit(name), F.col(f"_hi{i}")),
        ]
    if "Risk" in df.columns:
        total += [row("high_risk_count", F.lit(None), F.col("_hi_n")), row("high_risk_amount", F.lit(None), r(F.col("_hi_amt")))]
    else:
        total += [
            row("risk_distribution", F.lit("LOW"), F.col("_n")),
            row("high_risk_count", F.lit(None), F.lit(0)),
            row("high_risk_amount", F.lit(None), F.lit(0.0)),
        ]
    return totals.select(F.inline(F.array(*total)))


# ---- A03 on columns of any number of values --------------------------------------
TRACKED = 100_000  # values that the sketch of top_values holds
CANDIDATES = 4  # candidates for each value that is asked for


def top_values(df: DataFrame, column: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """A03, first ``k``: the most frequent values of a column with any number of values, with exact counts.

    A sketch of bounded size finds candidates in one pass, without a shuffle of the
    column's values; a second pass counts the candidates exactly.  A value that is no
    candidate has at most as many rows as the last candidate's estimate, which is never
    too low, or ``2 * error * n`` if the sketch does not hold it.  If the k-th exact count is
    above both, the result is whole.  Otherwise (no value stands out, or counts tie at the
    end) all values are counted.  Missing values are left out; ties go to the smaller value.
    """
    value = numeric_value(df, column) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else col(column)
    rows = df.select(value.alias(column)).where(value.isNotNull())
    name = "`" + column.replace("`", "``") + "`"
    wanted = min(CANDIDATES * k, tracked)
    n, found = rows.agg(F.count("*"), F.expr(f"approx_top_k({name}, {wanted}, {tracked})")).first()
    items = [r["item"] for r in found or []]  # at most CANDIDATES * k values
    order = (F.col("count").desc(), col(column).asc())
    if items:
        counted = rows.where(col(column).isin(items)).groupBy(col(column)).agg(F.count("*").alias("count"))
        top = [tuple(r) for r in counted.orderBy(*order).limit(k).collect()]  # k rows
        error = 3.5 / (1 << (-(-tracked * 4 // 3) - 1).bit_length())
        omitted = min(r["count"] for r in found) if len(items) == wanted else 0
        if len(top) == k and top[-1][1] > max(omitted, 2 * error * n):
            return df.sparkSession.createDataFrame(top, counted.schema)
    return rows.groupBy(col(column)).agg(F.count("*").alias("count")).orderBy(*order).limit(k)


MOST_VALUES = 10_000  # values of a column that the nested report holds; profile_long holds all


# ---- fixed values: dtype names the reference reports (pandas), by Spark type
PANDAS_DTYPES = {
    "bigint": "int64",
    "int": "int32",
    "smallint": "int16",
    "tinyint": "int8",
    "double": "float64",
    "float": "float32",
    "boolean": "bool",
    "string": "object",
    "timestamp": "datetime64[ns]",
    "timestamp_ntz": "datetime64[ns]",
}


def type_name(dtype: T.DataType, names: str = "pandas") -> str:
    spark_name = dtype.simpleString()
    return PANDAS_DTYPES.get(spark_name, "object") if names == "pandas" else spark_name


def profile_report(df: DataFrame, type_names: str = "pandas", most_values: int = MOST_VALUES) -> DataFrame:
    """The whole report as ONE row of nested columns (JSON-ready).

    Built from the rows of ``profile_long``: only here are the value counts folded into
    maps with ``map_from_entries``, the ``most_values`` most frequent values of each column
    (ranked where they are counted, so that no more of them meet).  ``data_types`` uses the dtype names the reference
    reports (int64, float64, object, bool, ...); ``type_names="spark"`` gives
    Spark's names.
    """
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.col("n").desc(), "key"))
    counts = value_count_rows(df).withColumn("place", place).where(F.col("place") <= most_values)
    counts = counts.select("section", "key", F.col("n").cast("double").alias("value"))
    long = long_rows(totals_row(df), df, None).union(counts)
    stats = {}
    nums = numeric_columns(df)
    sections = long.groupBy().agg(
        F.coalesce(F.max(F.when(F.col("section") == "total_transactions", F.col("value"))), F.lit(0.0))
        .cast("long")
        .alias("total_transactions"),
        F.max(F.when(F.col("section") == "high_risk_count", F.col("value"))).cast("long").alias("high_risk_count"),
        F.max(F.when(F.col("section") == "high_risk_amount", F.col("value"))).alias("high_risk_amount"),
        *[
            F.map_from_entries(
                F.transform(
                    # value_counts order: count descending, then value
                    F.array_sort(
                        F.collect_list(
                            F.when(
                                F.col("section") == s,
                                F.struct(F.col("value").cast("long").alias("n"), F.col("key").alias("key")),
                            )
                        ),
                        lambda a, b: F.when(a["n"] > b["n"], -1)
                        .when(a["n"] < b["n"], 1)
                        .when(a["key"] < b["key"], -1)
                        .when(a["key"] > b["key"], 1)
                        .otherwise(0),
                    ),
                    lambda e: F.struct(e["key"].alias("key"), e["n"].alias("value")),
                )
            ).alias(s)
            for _, s in COUNT_SECTIONS
        ],
        F.map_from_entries(
            F.collect_list(
                F.when(
                    F.col("section").isin("mean", "std", "min", "max"),
                    F.struct(F.concat_ws(".", F.col("key"), F.col("section")), F.col("value")),
                )
            )
        ).alias("_stats"),
    )
    for name in nums:
        stats[name] = F.struct(*[F.col("_stats")[f"{name}.{k}"].alias(k) for k in ("mean", "std", "min", "max")])
    stat_type = "map<string,struct<mean:double,std:double,min:double,max:double>>"
    summary = F.create_map(*[x for n, s in stats.items() for x in (F.lit(n), s)]) if stats else F.create_map().cast(stat_type)
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(type_name(f.dataType, type_names)))])
    out = sections.select(
        "total_transactions",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        types.alias("data_types"),
        summary.alias("summary_stats"),
        "risk_distribution",
        "high_risk_count",
        "high_risk_amount",
        *[s for c, s in COUNT_SECTIONS[1:] if c in df.columns],
    )
    return out
