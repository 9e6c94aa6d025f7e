"""Column -> Column helpers.  All built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import schema as S


def flag(predicate: Column) -> Column:
    """0/1 int from a predicate; a NULL comparison counts as False (pandas NaN rule)."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Exact lookup of ``key`` in a small literal map, ``default`` when absent.

    Compiled to one ``element_at(map, key)`` expression: no join, no shuffle.
    A missing key gives NULL (also under ANSI), then the default.
    """
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    value = F.element_at(F.create_map(*pairs), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def pick(index: Column, values: list[str]) -> Column:
    """``values[index]`` (0-based) from a literal list; NULL when out of range."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + F.lit(1))


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_value(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN normalised to NULL, so aggregates
    skip it the way pandas skips missing values."""
    c = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# ---- fixed values: non-ISO timestamp layouts accepted besides ISO 8601 -----
TIMESTAMP_FALLBACK_PATTERNS = [
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
    "yyyy-M-d h:mm:ss a",
    "yyyy-M-d h:mm a",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "d-MMM-yyyy H:mm:ss",
    "d-MMM-yyyy H:mm",
    "d-MMM-yyyy",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy H:mm",
    "d MMM yyyy",
    "MMM d, yyyy H:mm:ss",
    "MMM d, yyyy H:mm",
    "MMM d, yyyy",
    "yyyyMMdd H:mm:ss",
    "yyyyMMdd HHmmss",
    "yyyyMMdd H:mm",
    "yyyyMMdd",
]


# ---- fixed values: the shapes of ISO 8601 text, one layout each ------------
ISO_SHAPES = {
    "iso date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "iso minutes": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}$",
    "iso seconds": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "iso fraction": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}[.][0-9]{1,9}$",
    "iso T minutes": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{2}$",
    "iso T seconds": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "iso T fraction": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}[.][0-9]{1,9}$",
}
TIME_LAYOUTS = [*ISO_SHAPES, *TIMESTAMP_FALLBACK_PATTERNS]


def parse_layout(c: Column, layout: str) -> Column:
    """Text of one layout as a timestamp, in one expression; any other text is NULL."""
    if layout in ISO_SHAPES:
        return F.when(c.rlike(ISO_SHAPES[layout]), c.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(c, F.lit(layout)).cast("timestamp_ntz")


def layout_mask(c: Column) -> Column:
    """A bit for each of ``TIME_LAYOUTS`` that a text has; 0 for a missing one."""
    mask = F.lit(0).cast("long")
    for i, layout in enumerate(TIME_LAYOUTS):
        mask = mask + F.when(parse_layout(c, layout).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return mask


def parse_timestamp(c: Column) -> Column:
    """Lenient timestamp parse: bad text becomes NULL (no ANSI error).

    ISO 8601 text (date, optional time, optional fraction) is cast directly;
    month-first US layouts, slashed and compact dates and month names, with 24
    or 12 hours, are tried next, in order.  Eight digits are a date, not a year.
    """
    fallbacks = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in TIMESTAMP_FALLBACK_PATTERNS]
    iso = F.when(~F.coalesce(c.cast("string").rlike(r"^\s*[0-9]{5,}(\s|$)"), F.lit(False)), c.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *fallbacks)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``part * 100 / whole`` in double arithmetic, rounded to ``digits``."""
    value = part.cast("double") * F.lit(100.0) / whole.cast("double")
    return F.round(value, digits) if digits is not None else value


def rate_band(rate: Column) -> Column:
    """> 20 danger, > 10 warning, else success (strict comparisons)."""
    return (
        F.when(rate > S.RATE_DANGER_ABOVE, F.lit("danger"))
        .when(rate > S.RATE_WARNING_ABOVE, F.lit("warning"))
        .otherwise(F.lit("success"))
    )


def account_risk_level(fraud_count: Column) -> Column:
    """Any fraud in the account -> HIGH, else LOW."""
    return F.when(F.coalesce(fraud_count, F.lit(0)) > 0, F.lit("HIGH")).otherwise(F.lit("LOW"))


def zero_padded(prefix: str, n: Column, width: int, fmt: str) -> Column:
    """``prefix`` + n zero-padded to ``width`` digits, equal to ``fmt % n``.

    ``lpad`` alone would cut numbers longer than ``width``; those (and
    negative numbers) go through ``format_string``.  The common case stays a
    cheap codegen'd concat/lpad instead of a per-row String.format.
    """
    fast = F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))
    ok = (n >= 0) & (n < 10**width)
    return F.when(ok, fast).otherwise(F.format_string(fmt, n))


def format_txn_id(n: Column) -> Column:
    """``TXN%05d``; longer numbers are kept whole (no truncation)."""
    return zero_padded("TXN", n, 5, S.TXN_ID_FORMAT)


def format_account_id(n: Column) -> Column:
    """``ACC%03d``; longer numbers are kept whole."""
    return zero_padded("ACC", n, 3, S.ACCOUNT_ID_FORMAT)


def format_customer_name(n: Column) -> Column:
    """``Customer %d``."""
    return F.concat(F.lit("Customer "), n.cast("string"))


def format_timestamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text."""
    return F.date_format(ts, S.TIMESTAMP_FORMAT)


def fit_row(df: DataFrame, *aggs: Column) -> tuple:
    """Evaluate a few global aggregates in ONE job and return their values.

    The "fit" step of a fit/transform operator: partial aggregation per task,
    one row of ``len(aggs)`` values to the driver, then used as literals.
    """
    return tuple(df.agg(*aggs).first())
