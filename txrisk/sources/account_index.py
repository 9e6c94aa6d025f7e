"""The transaction table laid out for lookups by account.

The table is written once, range-split on (AccountID, order of the row) and
sorted, so an account's rows stand together in one file or, for a hot account,
in a run of files of the same size as all others.  Beside the rows stands a list
of files with each one's smallest and largest account.  A lookup reads from that list
the few files that can hold the account and opens only these; in them the sorted
row groups, the page index and the accounts' dictionary, or a Bloom filter where
that is too large, skip what does not match.  Nothing is written or shuffled by a lookup.

A new index is a new folder: readers of an older one are not disturbed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.accounts import row_order
from txrisk.operators.analytics import require

KEY = "AccountID"
ROWS, FILES = "rows", "files"
LOOKUP_KEYS = 1000  # accounts of one bulk lookup: they are literals of its plan
#: small pages and row groups, so that a lookup in a large file reads little of it
LAYOUT = {
    f"parquet.bloom.filter.enabled#{KEY}": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.page.row.count.limit": "5000",
    "parquet.block.size": str(32 << 20),
}


class AccountIndex:
    """A written index: ``rows_of`` gives the rows of some accounts from the files that hold them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = spark.read.parquet(f"{self.path}/{FILES}")
        self.schema = spark.read.parquet(f"{self.path}/{ROWS}").schema

    def files_of(self, accounts: Iterable[str]) -> list[str]:
        """The data files whose range of accounts covers one of ``accounts``."""
        wanted = sorted({a for a in accounts if a is not None})
        if not wanted:
            return []
        if len(wanted) > LOOKUP_KEYS:
            raise ValueError(f"at most {LOOKUP_KEYS} accounts a lookup; join with the table for more")
        covers = F.exists(F.array(*map(F.lit, wanted)), lambda a: (F.col("lo") <= a) & (a <= F.col("hi")))
        found = self.files.where(covers).select("file").toLocalIterator()  # the files of these accounts
        return sorted(f"{self.path}/{ROWS}/{r['file']}" for r in found)

    def rows_of(self, *accounts: str) -> DataFrame:
        """the rows of one or some accounts; no rows for an unknown or a missing one."""
        files = self.files_of(accounts)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        named = [a for a in accounts if a is not None]
        match = F.col(KEY) == named[0] if len(named) == 1 else F.col(KEY).isin(named)
        return self.spark.read.schema(self.schema).parquet(*files).where(match)


def build_account_index(df: DataFrame, path: str, order_by: str | None = None, files: int | None = None) -> AccountIndex:
    """Write ``df`` as an account index into the new folder ``path``.

    Splits come from Spark's range sampling over account and row order, so an
    account with a third of all rows spans a third of the files.  The number of files
    follows the session's shuffle settings (AQE sizes them) unless given.  Rows without
    an account are kept, first, for scans of the whole table.
    """
    require(df, "account_index", KEY)
    spark, keys = df.sparkSession, [F.col(KEY), *row_order(df, "account_index", order_by)]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    rows = f"{path.rstrip('/')}/{ROWS}"
    ranged.sortWithinPartitions(*keys).write.options(**LAYOUT).mode("errorifexists").parquet(rows)
    stored = spark.read.parquet(rows).select(KEY, F.col("_metadata.file_name").alias("file"))
    known = stored.groupBy("file").agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi"), F.count("*").alias("n_rows"), F.count(KEY).alias("n_known"))
    known.sort("lo").write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{FILES}")
    return AccountIndex(spark, path)
