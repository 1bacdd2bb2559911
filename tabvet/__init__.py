"""tabvet: clean, profile and judge a table with Spark.

Every operator takes DataFrames and returns DataFrames with a fixed schema,
so results compose, scale with the input and can be checked against SQL.
"""

__version__ = "0.1.0"
