"""spendlens: Spark-native operators for temporal analysis of transaction tables.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, so Catalyst sees one lazy plan per query.
"""

__version__ = "0.1.0"
