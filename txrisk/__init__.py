"""txrisk: Spark-native transaction-risk analytics.

Composable ``DataFrame -> DataFrame`` operators (features, rules, risk tiers,
aggregates, account roll-ups, profiles, a random-forest model) written with
built-in Spark SQL expressions and ``pyspark.ml``.
"""

__version__ = "0.1.0"
