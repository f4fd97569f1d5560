"""Event-outcome analytics on Spark.

Raw pitch-level events become classified plate appearances, daily and
strictly-prior running totals, shrunken rates, joined training and serving
tables, scored matchups and outcome histograms with odds.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the
caller writes or reads the result.
"""

__version__ = "0.1.0"
