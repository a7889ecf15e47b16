"""tablesmith: analytics for tables and event data, written as Spark jobs.

Every operator takes DataFrames and returns a DataFrame (or a fitted object that
maps one DataFrame to another), so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
