"""acrewise: land supply, employment and workforce analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from joins,
aggregations, windows and Column expressions, so Catalyst plans it and the
work scales out with the input tables.
"""

__version__ = "0.1.0"
