"""Reading, writing and handing out transaction tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import schema as S
from txrisk.functions.columns import col, fit_row
from txrisk.session import fresh_path
from txrisk.sources import csv_ranges

# CSV timestamp text: the reference format plus optional microseconds.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
# ---- fixed values: text that pandas reads as missing (exact, not trimmed) ----
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]
# quotes inside a quoted field are doubled, as pandas reads and writes them
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EXTRA = "_more_fields"
QUOTED_EMPTY = "\x01"  # how a quoted empty field reads, to tell it from a missing one


class UploadError(ValueError):
    """The input is not an acceptable CSV file."""


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """Scan the transaction table.

    Parquet keeps its own schema (column pruning and filter pushdown apply).
    CSV columns are found by their header names, in any order, and take the
    declared types (never inferred); a declared column that the header lacks
    is NULL, and files of one folder must agree on their header.  A "NaN" text
    becomes NULL.  ``multiline`` reads quoted line breaks, at the price of one
    task per file, so it is off for the stored table.  Parquet columns are
    left untouched so numeric filters still reach the row-group statistics;
    operators treat NaN as missing where they use a value (rules, aggregates,
    the zero fill).
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        declared = schema or S.TRANSACTION
        names = _header(spark, path, multiline)
        by_name = {f.name: f.dataType for f in declared.fields}
        found = T.StructType([T.StructField(n, by_name.get(n, T.StringType())) for n in names])
        reader = spark.read.schema(found).options(**CSV_DIALECT, multiLine=multiline, enforceSchema=False)
        reader = reader.option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT).option("emptyValue", QUOTED_EMPTY)
        df = reader.option("mode", "PERMISSIVE").csv(path)
        return nan_to_null(df.select(*[_declared(f, names) for f in declared.fields]))
    raise ValueError(f"unsupported format {fmt!r}")


def _declared(field: T.StructField, names: list[str]):
    if field.name not in names:
        return F.lit(None).cast(field.dataType).alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.when(col(field.name) == QUOTED_EMPTY, F.lit("")).otherwise(col(field.name)).alias(field.name)
    return col(field.name)


def _header(spark: SparkSession, path: str, multiline: bool) -> list[str]:
    """The names in the first line of a CSV file (or of a folder's first file)."""
    first = spark.read.options(**{**CSV_DIALECT, "header": False}, multiLine=multiline).csv(path).first()
    if first is None:
        raise UploadError("No columns to parse from file")
    return [n if n is not None else f"Unnamed: {i}" for i, n in enumerate(first)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in float / double columns (a projection; other columns untouched)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def check_upload(path: str | None) -> str:
    """The three rejections of an upload, with distinct messages."""
    if path is None:
        raise UploadError("No file provided")
    if path == "" or path.rstrip("/").split("/")[-1] == "":
        raise UploadError("No file selected")
    if not path.endswith(".csv"):
        raise UploadError("Please upload a CSV file")
    return path


def distinct_names(names: list[str]) -> list[str]:
    """Header names that Spark can tell apart: of names that are equal but for
    their case one keeps its name (a column of the transaction table, else the
    first), the others get a number."""
    keeps: dict[str, int] = {}
    for i, n in enumerate(names):
        kept = keeps.setdefault(n.lower(), i)
        if n in S.TRANSACTION.names and names[kept] not in S.TRANSACTION.names:
            keeps[n.lower()] = i
    taken, out = {n.lower() for n in names}, []
    for i, n in enumerate(names):
        name, k = n, 0
        while keeps[n.lower()] != i and name.lower() in taken:
            k += 1
            name = f"{n}.{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_csv_inferred(spark: SparkSession, path: str | None, multiline: bool = True) -> DataFrame:
    """Any CSV with a header; column types are inferred like the
    reference's reader does it.

    The fields are read as text (quoted commas, quotes and, with ``multiline``,
    line breaks; large files are read in ranges by many tasks either way), every
    spelling of "missing" becomes NULL, and they are written once to the shared
    folder.  ONE aggregate pass over the written columns decides each one's type:
    whole numbers without gaps -> bigint; numbers (or whole numbers with gaps) ->
    double; only True/False without gaps -> boolean; anything else stays text (dates
    included: they are parsed later by the feature step).  The result casts the
    written columns as they are read.  A row with more fields than the header is
    an ``UploadError``; missing ones are NULL.
    """
    check_upload(path)
    names = distinct_names(_header(spark, path, multiline))
    raw_names = [f"_c{i}" for i in range(len(names))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*raw_names, EXTRA]])
    stored = fresh_path(spark, "upload-text")
    for raw in _raw_fields(spark, path, text, multiline):
        known = [F.when(F.col(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c) for c in raw_names]
        raw.select(*known, F.when(F.col(EXTRA).isNotNull(), F.lit("x")).alias(EXTRA)).write.mode("append").parquet(stored)
    clean = spark.read.schema(text).parquet(stored)
    types = infer_types(clean)
    if types.pop(EXTRA) == "string":
        raise UploadError(f"Error tokenizing data: a row has more than {len(names)} fields")
    return clean.select(*[F.col(c).cast(t).alias(n) for (c, t), n in zip(types.items(), names, strict=True)])


def _raw_fields(spark: SparkSession, path: str, text: T.StructType, multiline: bool) -> list[DataFrame]:
    """The fields of all records as text, in one or two tables."""
    if not multiline or _carriage_returns_only(spark, path):
        return [spark.read.schema(text).options(**CSV_DIALECT, multiLine=multiline).option("mode", "PERMISSIVE").csv(path)]
    ddl = ", ".join(f"{n} string" for n in text.names)
    options = {k: str(v) for k, v in CSV_DIALECT.items() if k != "header"}
    one = F.regexp_replace("text", "\r$", "")  # a CRLF file
    return [r.select(F.from_csv(one, ddl, options).alias("r")).select("r.*") for r in csv_ranges.records(spark, path)]


def _carriage_returns_only(spark: SparkSession, path: str) -> bool:
    """Whether the lines end with a carriage return alone, which no range can be cut at."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    return first is not None and "\r" in first["value"].rstrip("\r") and '"' not in first["value"]


INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
BOOL_VALUES = ["True", "False", "TRUE", "FALSE", "true", "false"]


def infer_types(df: DataFrame) -> dict[str, str]:
    """Per text column: bigint / double / boolean / string.

    Each value is classed (missing 16, whole number 1, other number 2,
    True/False 4, other text 8) and the classes are OR-ed per column in one
    aggregate (partial per task, one row of N small ints to the driver).
    """
    classes = []
    for c in df.columns:
        x = col(c)
        # regex only: text matching FLOAT_PATTERN always parses as a double, and
        # whole numbers of at most 18 characters always fit a bigint; only
        # longer ones are cast (a cast that fails is costly under ANSI)
        fits = (F.length(F.trim(x)) <= 18) | x.try_cast("bigint").isNotNull()
        value_class = (
            F.when(x.isNull(), 16)
            .when(x.rlike(INT_PATTERN) & fits, 1)
            .when(x.rlike(FLOAT_PATTERN), 2)
            .when(x.isin(BOOL_VALUES), 4)
            .otherwise(8)
        )
        classes.append(F.bit_or(value_class))
    types = {}
    for c, mask in zip(df.columns, fit_row(df, *classes)):
        mask = mask or 0
        values = mask & ~16
        if values == 0:
            types[c] = "double"  # an all-missing column reads as NaN floats
        elif mask == 1:
            types[c] = "bigint"
        elif values & ~3 == 0:
            types[c] = "double"
        elif mask == 4:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def table_format(path: str) -> str:
    """The format of a stored table, by its name."""
    return "csv" if path.rstrip("/").endswith(".csv") else "parquet"


def write_transactions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write the table (CSV with a header and no index, or Parquet).

    CSV quotes are doubled; a missing value is an empty field, an empty text a
    quoted one, and blanks around a text are kept.
    """
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(**CSV_DIALECT).option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def load_or_materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet", schema=None
) -> DataFrame:
    """Read the stored table; when the path does not exist (or holds only
    the debris of a write that died before its commit), build it, write it
    and read the written copy back (lineage cut at the write).

    The write goes through Spark's commit protocol, so a reader never sees a
    half-written table: files appear only when the job commits.  A folder
    without a data file is not a table, in either format.
    """
    try:
        files = spark.read.format("text" if fmt == "csv" else fmt).load(path).inputFiles()
    except AnalysisException as exc:
        text = str(exc)
        if not any(m in text for m in ("PATH_NOT_FOUND", "Path does not exist", "UNABLE_TO_INFER_SCHEMA")):
            raise
        files = []
    if files:
        return read_transactions(spark, path, fmt, schema)
    write_transactions(build(), path, fmt, mode="overwrite")
    return read_transactions(spark, path, fmt, schema)


def register(df: DataFrame, name: str = "transactions") -> DataFrame:
    """Name the table for SQL."""
    df.createOrReplaceTempView(name)
    return df


def to_records(df: DataFrame, limit: int | None = None) -> list[dict]:
    """All rows of an aggregated result as dicts, fetched a partition at a time.

    ``limit`` gives that many first rows to a caller who asks for no more.  For
    results that may be large, write ``as_json(df)`` instead.
    """
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).toLocalIterator()]


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row (computed on the executors)."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("json"))


def smoke(spark: SparkSession, n: int = 100) -> int:
    """The start-up check: count a range of ``n`` rows."""
    return spark.range(n).count()


def active_dataset(base: DataFrame | None, uploaded: DataFrame | None = None) -> DataFrame | None:
    """The uploaded table when there is one, else the base table."""
    return uploaded if uploaded is not None else base
