"""Spark-native discovery analytics: signals in, ranked product gaps out.

Every operator is a function from DataFrames to a DataFrame; the reference
instant, windows and thresholds are arguments.
"""

__version__ = "0.1.0"
