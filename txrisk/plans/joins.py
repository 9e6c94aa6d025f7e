"""Fact-to-dimension join with an explicit answer to hot keys.

Default (``salt_buckets=0``): a plain equi-join.  Catalyst broadcasts the
dimension when its size is under the broadcast threshold; otherwise it is a
sort-merge join and AQE's skew-join splits a partition that a hot key made
oversized (``spark.sql.adaptive.skewJoin.enabled``).

``salt_buckets=N``: the fact rows of every key are spread over N salts taken
from a deterministic hash of the fact row (so a retried task rebuilds exactly
the same rows), and the dimension is replicated N times with one row per
salt.  A key holding a third of the fact table then lands in N partitions
instead of one; the result is the same as the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    how: str = "inner",
    salt_buckets: int = 0,
    salt_columns: list[str] | None = None,
) -> DataFrame:
    if salt_buckets <= 1:
        return fact.join(dim, fact[fact_key] == dim[dim_key], how)
    cols = salt_columns or fact.columns
    salted_fact = fact.withColumn(SALT, F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets)))
    salted_dim = dim.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt_buckets - 1).cast("long"))))
    cond = (salted_fact[fact_key] == salted_dim[dim_key]) & (salted_fact[SALT] == salted_dim[SALT])
    return salted_fact.join(salted_dim, cond, how).drop(salted_fact[SALT]).drop(salted_dim[SALT])
