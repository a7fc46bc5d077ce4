"""Monthly price panels on PySpark: cleaning, features, splits, models, scores.

Public functions take and return Spark DataFrames (or Columns); nothing is
computed until the caller runs an action, unless a docstring says so.
"""

__version__ = "0.1.0"
