"""retailcast: monthly retail sales features and forecasts on Spark.

Every public function takes and returns Spark DataFrames (or Columns) and
builds a lazy plan; nothing is collected unless a function says so.
"""

__version__ = "0.1.0"
