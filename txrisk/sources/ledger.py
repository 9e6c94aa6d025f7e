"""Figures kept by file, so that a growing table is read once.

A ledger stands beside a Parquet table.  For every data file it holds a row with
the number of rows, each numeric column's count, mean, sum of squared deviations, smallest and
largest value, a sketch of the accounts, the label's sum, the high-risk totals and
the smallest and largest row order; and a row for every value of the counted columns.
``extend`` reads the files that the ledger does not know yet and appends theirs.  The
figures of the whole table are merged from these rows:

* means and deviations by Chan's rule for any number of parts;
* distinct accounts by the union of the sketches (an estimate; the exact count of
  ``dataset_summary`` stays the default);
* value counts by sums;
* the first accounts by reading files in the order of their smallest row, until no
  unread file can hold an earlier one.

A batch of rows counts as known when its file list is written, which is the last step;
what a failed batch left is ignored.  A file counts by path, size and time: a changed
file is read again, and a removed one no longer counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import schema as S
from txrisk.functions.columns import numeric_value
from txrisk.operators.accounts import row_order
from txrisk.operators.profile import amount_column, long_rows, numeric_columns, value_cells

SKETCH_LG_K = 14  # 2**14 registers: a standard error of about 0.8 %
STATS = "array<struct<column:string,n:bigint,mean:double,m2:double,min:double,max:double>>"
FILE_ROW = (
    f"file string, size bigint, modified timestamp, batch string, n_rows bigint, stats {STATS}, accounts binary, null_accounts bigint, "
    "labelled bigint, label_sum double, high bigint, high_amount double, first_order bigint, last_order bigint"
)
COUNT_ROW = "file string, modified timestamp, batch string, section string, key string, n bigint"


def _plain(path: Column) -> Column:
    """A file's path as one spelling, with or without an empty host."""
    return F.regexp_replace(path, r"^([A-Za-z0-9]+):///", r"$1:/")


class FileLedger:
    """The ledger of one Parquet table."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table.rstrip("/"), path.rstrip("/")

    # ---- what is there -------------------------------------------------------
    def listing(self) -> DataFrame:
        """(file, size, modified) of the table's data files, listed without being opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.table)
        return files.select(_plain(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """A row for every known file that the table has now."""
        rows = self._stored("files", FILE_ROW).join(self.listing(), ["file", "size", "modified"], "left_semi")
        once = rows.groupBy("file").agg(F.min("batch").alias("batch"))  # two writers may have read the same file
        return rows.join(once, ["file", "batch"], "left_semi")

    def unknown(self) -> list[str]:
        """The files that are not read yet."""
        new = self.listing().join(self._stored("files", FILE_ROW), ["file", "size", "modified"], "left_anti")
        return sorted(r["file"] for r in new.select("file").toLocalIterator())

    # ---- reading new files ------------------------------------------------------
    def extend(self) -> list[str]:
        """Read the files that are not known yet, append their figures, and return their names."""
        files = self.unknown()
        if not files:
            return []
        batch = uuid.uuid4().hex
        df = self.spark.read.parquet(*files)
        tagged = df.select("*", _plain(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))
        cells = value_cells(df)
        if cells:
            keys = tagged.select("_file", "_modified", F.explode(F.array(*cells)).alias("cell")).select("_file", "_modified", "cell.*")
            counts = keys.where("key is not null").groupBy("_file", "_modified", "section", "key").agg(F.count("*").alias("n"))
            counts.select(F.col("_file").alias("file"), F.col("_modified").alias("modified"), F.lit(batch).alias("batch"), "section", "key", "n").write.mode(
                "append"
            ).parquet(f"{self.path}/counts")
        self._figures(df, tagged, files, batch).write.mode("append").parquet(f"{self.path}/files")
        return files

    def _figures(self, df: DataFrame, tagged: DataFrame, files: list[str], batch: str) -> DataFrame:
        nums = numeric_columns(df)
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        for i, c in enumerate(nums):
            x = numeric_value(df, c)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        if "AccountID" in df.columns:
            aggs += [F.hll_sketch_agg("AccountID", F.lit(SKETCH_LG_K)).alias("accounts"), F.count_if(F.col("AccountID").isNull()).alias("null_accounts")]
        if "IsFraud" in df.columns:
            label = numeric_value(df, "IsFraud")
            aggs += [F.count(label).alias("labelled"), F.sum(label).alias("label_sum")]
        if "Risk" in df.columns:
            high, amount = F.col("Risk") == "HIGH", amount_column(df)
            value = F.sum(F.when(high, numeric_value(df, amount))) if amount else F.lit(None)
            aggs += [F.count_if(high).alias("high"), F.coalesce(value, F.lit(0.0)).cast("double").alias("high_amount")]
        if {"txn_no", "TransactionID"} & set(df.columns):
            order = row_order(df, "ledger")[0].cast("long")
            aggs += [F.min(order).alias("first_order"), F.max(order).alias("last_order")]
        rows = tagged.groupBy("_file", "_modified").agg(*aggs)
        stats = [
            F.struct(
                F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"), (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2"),
                F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
            )
            for i, c in enumerate(nums)
        ]
        rows = rows.withColumn("stats", F.array(*stats) if stats else F.array().cast(STATS))
        # a file without rows is known, too
        rows = self.listing().where(F.col("file").isin(files)).join(rows, F.col("file") == F.col("_file"), "left").withColumn("batch", F.lit(batch))
        wanted = T.StructType.fromDDL(FILE_ROW)
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])

    # ---- figures of the whole table ---------------------------------------------
    def schema(self) -> DataFrame:
        """The table itself, for its columns."""
        return self.spark.read.parquet(self.table)

    def statistics(self) -> DataFrame:
        """(column, n, mean, std, min, max) of each numeric column, merged from the files."""
        parts = self.rows().select(F.inline("stats"))
        whole = parts.where("n > 0").groupBy("column").agg(
            F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max")
        )
        apart = parts.where("n > 0").join(whole.select(F.col("column").alias("c"), F.col("mean").alias("all")), F.col("column") == F.col("c"))
        off = F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all"))
        spread = apart.groupBy("c").agg(F.sum(off).alias("m2"))
        std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
        return whole.join(spread, F.col("column") == F.col("c")).select("column", "n", "mean", std.alias("std"), "min", "max")

    def numeric_profile(self, digits: int | None = None) -> DataFrame:
        """A05 from the ledger: the rows of ``profile.numeric_profile``."""
        names = numeric_columns(self.schema())
        places = self.spark.createDataFrame(list(enumerate(names)), "position int, column string")
        found = places.join(self.statistics(), "column", "left")
        r = lambda c: F.round(c, digits).alias(c) if digits is not None else F.col(c)
        return found.select("position", "column", r("mean"), r("std"), "min", "max")

    def profile_long(self, digits: int | None = 6) -> DataFrame:
        """A13 from the ledger: the rows of ``profile.profile_long``."""
        df, rows = self.schema(), self.rows()
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_rows", "_n"), ("high", "_hi_n"), ("high_amount", "_hi_amt"))])
        nums = numeric_columns(df)
        table = self.numeric_profile().agg(
            *[F.max(F.when(F.col("position") == i, F.col(c))).alias(f"{p}{i}") for i in range(len(nums)) for c, p in (("mean", "_m"), ("std", "_s"), ("min", "_lo"), ("max", "_hi"))]
        )
        counts = self.value_counts().select("section", "key", F.col("n").cast("double").alias("value"))
        wide = sums.unionByName(table, allowMissingColumns=True) if nums else sums  # one row each
        wide = wide.agg(*[F.max(c).alias(c) for c in wide.columns])
        return long_rows(wide, df, digits).union(counts)

    def value_counts(self) -> DataFrame:
        """(section, key, n): the counted columns' values, summed over the files."""
        known = self.rows().select("file", "modified", "batch")
        rows = self._stored("counts", COUNT_ROW).join(known, ["file", "modified", "batch"], "left_semi")
        return rows.groupBy("section", "key").agg(F.sum("n").alias("n"))

    def dataset_summary(self) -> DataFrame:
        """A06 from the ledger: rows, columns, estimated accounts (a missing one counts as one), mean label."""
        found = self.rows().agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("accounts"),
            F.max((F.col("null_accounts") > 0).cast("long")).alias("missing"), (F.sum("label_sum") / F.sum("labelled")).alias("fraud_mean"),
        )
        n = (F.coalesce("accounts", F.lit(0)) + F.coalesce("missing", F.lit(0))).cast("long").alias("n_accounts")
        return found.select("n_rows", F.lit(len(self.schema().columns)).alias("n_columns"), n, "fraud_mean")

    def first_accounts(self, k: int = S.ACCOUNT_LIMIT) -> tuple[DataFrame, list[str]]:
        """The first ``k`` accounts by row order, and the files that were read for them.

        Files are taken in the order of their smallest row, in rounds of doubling
        size.  When ``k`` accounts begin before the smallest row of every unread file, no other
        account can be among them.
        """
        best = self.spark.createDataFrame([], "AccountID string, first bigint")
        waiting = self.rows().where("first_order is not null").select("file", "first_order").orderBy("first_order", "file")
        read, size, after = [], 1, None
        while True:
            some = waiting if after is None else waiting.where((F.col("first_order") > after[0]) | ((F.col("first_order") == after[0]) & (F.col("file") > after[1])))
            some = some.limit(size + 1).collect()  # the next files and the first of the rest
            if not some:
                return best.select("AccountID"), read
            files, rest = [r["file"] for r in some[:size]], some[size:]
            rows = self.spark.read.parquet(*files)
            order = row_order(rows, "first_accounts")[0].cast("long")
            found = rows.groupBy("AccountID").agg(F.min(order).alias("first")).where("first is not null")
            top = best.union(found).groupBy("AccountID").agg(F.min("first").alias("first")).orderBy("first", "AccountID").limit(k)
            held = [(r["AccountID"], r["first"]) for r in top.collect()]  # k rows
            best = self.spark.createDataFrame(held, "AccountID string, first bigint")
            read += files
            if not rest or (len(held) == k and held[-1][1] < rest[0]["first_order"]):
                return best.select("AccountID"), read
            after, size = (some[size - 1]["first_order"], some[size - 1]["file"]), 2 * size
